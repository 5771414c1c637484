"""Dictionary matching of whole words, with overlap resolution, in one pass over the lines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,entity_id:string,form:string,alias_ord:int,shared:boolean,nested_in:string>>"
#: The dictionary is sent to the tasks up to this many aliases, counted first; beyond, every n-gram is joined with it.
BROADCAST_ALIASES = 1_000_000
#: Lines of a batch that are Python objects at once.
SLICE = 2000

Found = tuple[int, int, int, int, str, str, bool]  # start, minus the length, alias order, end, entity, form, shared


def scan(text: str, forms: dict[str, list[tuple[str, int]]], longest: dict[str, list[int]]) -> list[Found]:
    """All occurrences in a single-spaced text, by words; ``longest`` has, for each first word of a form, the numbers of words of such forms."""
    found: list[Found] = []
    words, at = text.split(" ") if text else [], 0
    for i, word in enumerate(words):
        for n in longest.get(word, ()):
            form = word if n == 1 else " ".join(words[i : i + n])
            who = forms.get(form, ()) if i + n <= len(words) else ()
            found += [(at, -len(form), order, at + len(form), entity, form, len({e for e, _ in who}) > 1) for entity, order in who]
        at += len(word) + 1
    return found


def resolve(found: list[Found], strict_longest: bool = False) -> list[tuple]:
    """Overlap resolution of one line's occurrences: SPAN tuples.

    In order of start, then longest, then alias order: a match that crosses a kept one and is not
    longer is dropped; one that lies within kept ones is kept and names the last of them. A longer
    crossing match leaves the shorter one in place, unless ``strict_longest``. Only kept matches that
    reach beyond the current start can matter, so the work is linear in the matches.
    """
    kept: dict[int, tuple] = {}
    open_: list[int] = []
    for number, (start, _, order, end, entity, form, shared) in enumerate(sorted(found)):
        open_ = [k for k in open_ if kept[k][1] > start]
        crossed = [k for k in open_ if kept[k][0] < start and kept[k][1] < end]
        if any(end - start <= kept[k][1] - kept[k][0] for k in crossed):
            continue
        around = [kept[k][2] for k in open_ if kept[k][0] <= start and kept[k][1] >= end]
        if strict_longest:
            for k in crossed:
                del kept[k]
                open_.remove(k)
        kept[number] = (start, end, entity, form, order, shared, around[-1] if around else None)
        open_.append(number)
    return list(kept.values())


_KINDS = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
_NAMES = ("start", "end", "entity_id", "form", "alias_ord", "shared", "nested_in")


def _columns(spans: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(list(zip(*spans, strict=True)) or [()] * 7, _KINDS, strict=True)]


def _spans(rows: list[list[tuple]]) -> pa.Array:
    edges = [0]
    for row in rows:
        edges.append(edges[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(_columns([x for row in rows for x in row]), _NAMES))


def _in_runs(texts: list[str | None], vocabulary: frozenset[str], find: Callable[[str], list[tuple]]) -> pa.Array:
    """SPAN arrays of the texts, where ``find`` gives those of a run: words of the vocabulary in a row.

    Matches lie within runs and runs do not touch, so that each is resolved by itself; one that
    comes again in ``texts`` is only moved to its place.
    """
    known: dict[str, int] = {}
    runs, places, edges = [], [], [0]
    for text in texts:
        at = begin = 0
        run: list[str] = []
        for word in text.split(" ") if text else ():
            if word in vocabulary:
                if not run:
                    begin = at
                run.append(word)
            elif run:
                runs.append(known.setdefault(" ".join(run), len(known)))
                places.append(begin)
                run = []
            at += len(word) + 1
        if run:
            runs.append(known.setdefault(" ".join(run), len(known)))
            places.append(begin)
        edges.append(len(runs))
    each = [find(run) for run in known]
    columns = _columns([x for spans in each for x in spans])
    size = np.array([len(spans) for spans in each], np.int64)
    of = np.array(runs, np.int64)
    n = size[of]
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[of] - ends[:-1], n)
    moved = np.repeat(np.array(places, np.int32), n)
    columns = [c.take(pa.array(take)) for c in columns]
    columns[:2] = [pa.array(c.to_numpy() + moved, pa.int32()) for c in columns[:2]]
    return pa.ListArray.from_arrays(pa.array(ends[edges], pa.int32()), pa.StructArray.from_arrays(columns, _NAMES))


def small(aliases: DataFrame) -> list | None:
    """The aliases as rows if there are at most BROADCAST_ALIASES, else None."""
    rows = aliases.select("form", "entity_id", "alias_ord", "n_words").limit(BROADCAST_ALIASES + 1).collect()
    return rows if len(rows) <= BROADCAST_ALIASES else None


def spans(text: Column, known: list, case_fold: bool = True, strict_longest: bool | None = False) -> Column:
    """SPAN array of a single-spaced text: its matches after resolution, or all occurrences with ``strict_longest`` None.

    Null and empty texts have none. The dictionary's rows travel with the function.
    """
    forms: dict[str, list[tuple[str, int]]] = {}
    longest: dict[str, list[int]] = {}
    vocabulary = frozenset(word for r in known for word in r["form"].split(" "))
    for r in known:
        forms.setdefault(r["form"], []).append((r["entity_id"], r["alias_ord"]))
        sizes = longest.setdefault(r["form"].split(" ")[0], [])
        if r["n_words"] not in sizes:
            sizes.append(r["n_words"])

    def every(found: list[Found]) -> list[tuple]:
        return [(s, end, e, form, o, shared, None) for s, _, o, end, e, form, shared in sorted(found)]

    @F.arrow_udf(SPAN)
    def find(texts: pa.Array) -> pa.Array:
        done = every if strict_longest is None else lambda x: resolve(x, strict_longest)
        slices = (texts.slice(i, SLICE).to_pylist() for i in range(0, len(texts), SLICE))
        return pa.concat_arrays([_in_runs(part, vocabulary, lambda run: done(scan(run, forms, longest))) for part in slices] or [_spans([])])

    return find(F.lower(text) if case_fold else text)


def grams(text: Column, sizes: list[int], case_fold: bool = True) -> Column:
    """Every run of so many words of a single-spaced text, with its start."""

    @F.arrow_udf("array<struct<form:string,start:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        forms, starts, edges = [], [], [0]
        for t in texts.to_pylist():
            words, at = t.split(" ") if t else [], 0
            for i, word in enumerate(words):
                for n in sizes:
                    if i + n <= len(words):
                        forms.append(" ".join(words[i : i + n]))
                        starts.append(at)
                at += len(word) + 1
            edges.append(len(forms))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(starts, pa.int32())], ["form", "start"]))

    return cut(F.lower(text) if case_fold else text)


def _joined(lines: DataFrame, aliases: DataFrame, text_col: str, case_fold: bool) -> DataFrame:
    """``lines`` (but for the text) with form, start and the alias columns of every occurrence, by a join of all n-grams with a large dictionary."""
    sizes = sorted(r["n_words"] for r in aliases.select("n_words").distinct().collect())  # lengths, not aliases
    keep = [c for c in lines.columns if c != text_col]
    each = lines.select(*keep, F.inline(grams(F.col(text_col), sizes, case_fold)))
    several = aliases.groupBy("form").agg((F.countDistinct("entity_id") > 1).alias("shared"))
    return each.join(aliases.join(several, "form").select("form", "entity_id", "alias_ord", "shared"), "form").withColumn("end", F.col("start") + F.length("form"))


def occurrences(lines: DataFrame, aliases: DataFrame, text_col: str = "text", case_fold: bool = True) -> DataFrame:
    """``lines`` (but for the text) with form, start, end, entity_id, alias_ord, shared of every occurrence.

    A match is a run of whole words of the single-spaced text. Null and empty texts have none.
    """
    known, keep = small(aliases), [c for c in lines.columns if c != text_col]
    if known is None:
        return _joined(lines, aliases, text_col, case_fold).select(*keep, "form", "start", "end", "entity_id", "alias_ord", "shared")
    return lines.select(*keep, F.inline(spans(F.col(text_col), known, case_fold, None))).select(*keep, "form", "start", "end", "entity_id", "alias_ord", "shared")


def matched(lines: DataFrame, aliases: DataFrame, text_col: str = "text", strict_longest: bool = False, case_fold: bool = True, name: str = "matches") -> DataFrame:
    """``lines`` with the SPAN array of their matches: no shuffle, and no second scan for what else a line is asked.

    With a dictionary too large to send, each line's occurrences come from a join and are brought
    together again under a row number; the rest is the same.
    """
    known = small(aliases)
    if known is not None:
        return lines.withColumn(name, spans(F.col(text_col), known, case_fold, strict_longest))

    @F.arrow_udf(SPAN)
    def settle(found: pa.Array) -> pa.Array:
        return _spans([resolve([tuple(x.values()) for x in row or []], strict_longest) for row in found.to_pylist()])

    numbered = lines.withColumn("__row", F.xxhash64(*lines.columns))  # rows alike in every column have the same matches
    one = F.struct("start", (-F.length("form")).alias("neg"), "alias_ord", "end", "entity_id", "form", "shared")
    found = _joined(numbered.select("__row", text_col).distinct(), aliases, text_col, case_fold).groupBy("__row").agg(F.collect_list(one).alias("__found"))
    return numbered.join(found, "__row", "left").withColumn(name, settle(F.col("__found"))).drop("__row", "__found")


def exploded(with_matches: DataFrame, keys: tuple[str, ...] = ("line_uid",), polysemous: tuple[str, ...] = (), name: str = "matches") -> DataFrame:
    """One row per match of ``matched``: keys, entity_id, form, start, end, alias_ord, confidence, rule_id, nested_in.

    Confidence is MEDIUM if the form is shared by several entities or the entity is polysemous, else HIGH.
    """
    found = with_matches.select(*keys, F.inline(name))
    unsure = F.col("shared") | (F.col("entity_id").isin(*polysemous) if polysemous else F.lit(False))
    return found.select(*keys, "entity_id", "form", "start", "end", "alias_ord", F.when(unsure, "MEDIUM").otherwise("HIGH").alias("confidence"), F.lit("alias_exact").alias("rule_id"), "nested_in")


def match(lines: DataFrame, aliases: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("line_uid",), polysemous: tuple[str, ...] = (), strict_longest: bool = False, case_fold: bool = True) -> DataFrame:
    """One row per kept match of every line, see ``exploded``."""
    return exploded(matched(lines.select(*keys, text_col), aliases, text_col, strict_longest, case_fold, "__m"), keys, polysemous, "__m")
