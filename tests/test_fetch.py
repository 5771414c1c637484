import json

import pytest

from versicle.sources.fetch import Blocked, Fetcher

TEXT = "x" * 200


def test_retries_then_gives_up(tmp_path):
    answers, waits = [(500, ""), (200, "short"), (200, TEXT)], []
    fetcher = Fetcher("http://a.example/{}", str(tmp_path), get=lambda url: answers.pop(0), sleep=waits.append)
    assert fetcher.one(1) == TEXT and waits == [1.0, 2.0]
    waits.clear()
    with pytest.raises(OSError):
        Fetcher("u{}", str(tmp_path), retries=7, get=lambda url: (500, ""), sleep=waits.append).one(1)
    assert waits == [1, 2, 4, 8, 16, 32, 32]
    with pytest.raises(Blocked):
        Fetcher("u{}", str(tmp_path), get=lambda url: (429, ""), sleep=waits.append).one(1)


def test_run_resumes_and_stops_when_blocked(tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return (403, "") if int(url) > 3 else (200, TEXT)

    fetcher = Fetcher("{}", str(tmp_path), get=get, sleep=lambda s: None)
    assert fetcher.run(range(1, 10), seed=1) == {"done": [1, 2, 3], "failed": [4, 5, 6], "stopped": True}
    asked.clear()
    again = Fetcher("{}", str(tmp_path), get=lambda url: asked.append(url) or (200, TEXT), sleep=lambda s: None).run(range(1, 7))
    assert again["done"] == [1, 2, 3, 4, 5, 6] and asked == ["4", "5", "6"]
    assert json.loads((tmp_path / "fetch_state.json").read_text()) == again and (tmp_path / "ang_0001.html").read_text() == TEXT
