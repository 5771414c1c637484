"""Column functions: normalisation, tokenisation, identifiers, labels and rates.

All are built-in expressions but ``token_spans``, whose running search no built-in function does in
linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that the normalisation policies are about.
ZERO_WIDTH = "‌‍"
NUKTA = "਼"
NUKTA_COMPOSED = "ਲ਼ਸ਼ਖ਼ਗ਼ਜ਼ੜਫ਼"
NUKTA_BASES = "ਲਸਖਗਜਡਫ"
BINDI, TIPPI = "ਂ", "ੰ"
DANDA, DOUBLE_DANDA = "।", "॥"
NUMERALS = "੦੧੨੩੪੫੬੭੮੯"
REFRAIN = "ਰਹਾਉ"
SCRIPT = "\\x{0A00}-\\x{0A7F}"
#: Stripped from the ends of words.
ENDS = "।॥;,.-–—:!?()"
#: A text without one of these has no structural marker.
MARKED = f"[{DANDA}{DOUBLE_DANDA}{NUMERALS}]|{REFRAIN}"
#: Ranges of code points expected in canonical text: the script, dandas, blanks and digits of ASCII.
EXPECTED = f"{SCRIPT}।॥\\x{{200C}}\\x{{200D}} -~"


@dataclass(frozen=True)
class Normalization:
    """Policies, each one of the listed words; ``normalize`` applies them in a fixed order."""

    nukta: str = "preserve"  # preserve, strip, dual
    nasal: str = "tippi"  # tippi, bindi, preserve
    vishram: str = "strip"  # strip, preserve_separate, preserve
    halant: str = "preserve"  # preserve, decompose: both equal NFC

    def __post_init__(self):
        for field, allowed in (("nukta", ("preserve", "strip", "dual")), ("nasal", ("tippi", "bindi", "preserve")), ("vishram", ("strip", "preserve_separate", "preserve")), ("halant", ("preserve", "decompose"))):
            if getattr(self, field) not in allowed:
                raise ValueError(f"{field} must be one of {allowed}")

    def steps(self) -> list[str]:
        """Provenance: the names of the seven steps with their policies."""
        return ["unicode_nfc", "strip_zero_width", f"nukta_{self.nukta}", f"nasal_{self.nasal}", f"vishram_{self.vishram}", f"halant_{self.halant}", "collapse_whitespace"]


def nfc(text: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark itself ships, so that no text leaves the JVM; ASCII texts are NFC already."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))  # False: canonical forms alone
    return F.coalesce(F.when(text.rlike("[^\\x00-\\x7F]"), composed), text)


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) to one space, ends trimmed; single spaces, which stay, are not replaced one by one."""
    return F.trim(F.regexp_replace(text, "(?U)\\s{2,}|[\\s&&[^ ]]", " "))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def nukta(text: Column, policy: str) -> Column:
    return F.translate(text, NUKTA_COMPOSED + NUKTA, NUKTA_BASES) if policy == "strip" else text


def nasal(text: Column, policy: str) -> Column:
    return {"tippi": F.translate(text, BINDI, TIPPI), "bindi": F.translate(text, TIPPI, BINDI), "preserve": text}[policy]


def vishram(text: Column, policy: str) -> Column:
    """Strip pause marks (a danda next to a digit stays), or set dandas apart."""
    if policy == "strip":
        return F.regexp_replace(text, f"[;,{DOUBLE_DANDA}]|(?<!\\p{{Nd}}){DANDA}(?!\\p{{Nd}})", "")
    return F.regexp_replace(text, f"[{DANDA}{DOUBLE_DANDA}]", " $0 ") if policy == "preserve_separate" else text


def normalize(text: Column, policy: Normalization = Normalization()) -> Column:
    """Canonical form of a text; applying it twice changes nothing more. A null stays null."""
    text = strip_zero_width(nfc(text))
    return collapse(vishram(nasal(nukta(text, policy.nukta), policy.nasal), policy.vishram))


def normalize_dual(text: Column, policy: Normalization = Normalization()) -> tuple[Column, Column]:
    """The text with nukta signs kept and with them stripped."""
    make = lambda n: normalize(text, Normalization(n, policy.nasal, policy.vishram, policy.halant))
    return make("preserve"), make("strip")


def structural_markers(text: Column) -> tuple[Column, Column]:
    """The markers (refrain words, double dandas, dandas, numerals that stand alone, in this order) and the text with spaces for them."""
    found = []
    for pattern, group in ((f"(?U)\\b{REFRAIN}\\b", 0), (DOUBLE_DANDA, 0), (DANDA, 0), (f"(?U)(?:^|\\s)([{NUMERALS}]+)(?:\\s|$)", 1)):
        found.append(F.regexp_extract_all(text, F.lit(pattern), group))
        text = F.regexp_replace(text, pattern, " ")  # a numeral takes its space along: the next one stays a token
    return F.concat(*found), text


def words(text: Column) -> Column:
    """Words of a text by single spaces; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words of the text without markers, punctuation stripped from their ends."""
    _, cleaned = structural_markers(text)  # used once: an expression within ``transform`` is not shared but evaluated for each use
    cleaned = F.when(text.rlike(MARKED), cleaned).otherwise(text)
    return F.array_remove(F.transform(F.split(collapse(cleaned), " "), lambda w: F.btrim(w, F.lit(ENDS))), "")


def token_count(text: Column) -> Column:
    """Number of ``tokens`` of a collapsed text; where it has neither markers nor words of punctuation alone, its words are counted by their spaces."""
    apart = ENDS.replace("-", "\\-")
    odd = (text == "") | text.rlike(f"{MARKED}|(?:^| )[{apart}]+(?: |$)")
    return F.when(odd, F.size(tokens(text))).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long")


def token_spans(text: Column, of: Column, restart: bool = True) -> Column:
    """[start, end) of each token, searched from left to right; one not found onwards is searched from the start (``restart``) or gets -1, -1.

    Null without tokens. One running search over each line, in Arrow batches.
    """

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def find(texts: pa.Array, tokens: pa.Array) -> pa.Array:
        starts, ends, edges, valid = [], [], [0], []
        for line, words in zip(texts.to_pylist(), tokens.to_pylist(), strict=True):
            at = 0
            for word in words or ():
                i = (line or "").find(word, at)
                if i < 0 and restart:
                    i = (line or "").find(word)
                starts.append(i)
                ends.append(i + len(word) if i >= 0 else -1)
                at = ends[-1] if i >= 0 else at
            edges.append(len(starts))
            valid.append(words is not None)
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans, mask=pa.array([not x for x in valid], pa.bool_()))

    return find(text, of)


def has_script(text: Column) -> Column:
    return text.rlike(f"[{SCRIPT}]")


def script_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, f"[^{SCRIPT}]", "")) / n)


def unexpected_characters(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([^{EXPECTED}])"), 1))


def numeral(text: Column) -> Column:
    """Value of the first run of script numerals, or null; also for a run beyond 64 bits (over 18 digits)."""
    run = F.regexp_extract(text, f"[{NUMERALS}]+", 0)
    return F.when(run != "", F.translate(run, NUMERALS, "0123456789").try_cast("long"))


def line_uid(page: Column, line_id: Column, text: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", page, line_id, text), 256)
    return F.concat(F.lit("ang"), page.cast("string"), F.lit(":sha256:"), F.substring(digest, 1, 12))


def group_uid(page: Column, position: Column) -> Column:
    return F.concat(F.lit("shabad:"), F.substring(F.sha2(F.concat_ws(":", page, position), 256), 1, 12))


def bucket(page: Column, size: int = 100) -> Column:
    """Label of the page's range, such as "101-200"; "unknown" below page 1."""
    low = F.floor((page - 1) / size) * size + 1
    return F.when(page > 0, F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string"))).otherwise("unknown")


def chunk(page: Column, size: int = 50, places: int | None = None) -> Column:
    """Label of the page's range, such as "chunk_051-100"; with ``places`` its numbers keep that many characters, as those of SQL's lpad do."""
    low = F.floor((page - 1) / size) * size + 1
    if places is None:
        return F.format_string("chunk_%03d-%03d", low, low + size - 1)
    return F.concat(F.lit("chunk_"), F.lpad(low.cast("string"), places, "0"), F.lit("-"), F.lpad((low + size - 1).cast("string"), places, "0"))


def density(count: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(count / n, 6))


def rate(count: Column, total: Column, per: int) -> Column:
    """Count per ``per`` of the total, four places; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(count * F.lit(float(per)) / total, 4))


def sigmoid(x: Column, k: float, x0: float) -> Column:
    e = -F.lit(float(k)) * (x - F.lit(float(x0)))
    return F.when(e > 500, F.lit(0.0)).when(e < -500, F.lit(1.0)).otherwise(1 / (1 + F.exp(e)))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * F.lit(100.0) / whole, places))
