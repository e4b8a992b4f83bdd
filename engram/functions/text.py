"""Scalar text functions as Column builders: tokenising, gates, keys, labels, routing. All but ``hash_code`` stay in the JVM."""

from __future__ import annotations

import functools
import hashlib
import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
CREDENTIAL_MARKS = ("ghp_", "github_pat_", "pypi-AgEI", "sk-ant-", "sk-proj-", "AKIA", "-----BEGIN", "xoxb-", "xoxp-", "npm_", "hf_", "AIza", "glpat-", "gho_", "xoxa-", "sk_live_")
CREDENTIAL_PATTERNS = (r"rc-[0-9a-f]{32,}", r"user_[A-Za-z0-9]{32,}", r"sk-[A-Za-z0-9_-]{20,}", r"gsk_[A-Za-z0-9]{20,}")
LONG_TOKEN = r"(?i)\b[A-Za-z0-9_-]{40,}\b(?=.*(?:key|token|secret))"
SOURCE_WEIGHT = {"model": 1.15, "import": 1.15, "model-supersede": 1.15, "hook": 0.9, "auto": 1.0}
ROUTES = (
    ("state", ("current", "now", "currently", "现在", "当前")),
    ("history", ("ever", "used to", "before", "previously", "history", "以前", "曾经", "之前")),
    ("temporal", ("how long", "how many years", "when did", "first", "order", "多久", "什么时候", "先", "顺序")),
    ("aggregation", ("total", "how many", "how much", "sum", "count", "一共", "总共", "多少")),
)
STOP_WORDS = "the a an and or of to in on for with is are was were be been i my me you your it its this that these those do does did have has had how many much more most often long much what which who when where why than from at as by".split()
CUT_MARKS = ("。", "！", "？", ".", "!", "?", "；", ";")

CJK = "一-鿿"
#: Inside a character class: marks that end a sentence, marks that a long sentence is packed at, and blanks of any script.
ENDS, COMMAS = "。！？；!?", "，,、：:"
PLAIN_COMMAS = "".join(filter(str.isascii, COMMAS))
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same blanks, one by one.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Counts that a task of ``hash_code`` holds at once, and words whose hashes it keeps.
CELLS, WORDS = 1 << 20, 200_000


def tokens(t: Column) -> Column:
    """Distinct lowered ASCII words of two characters or more, and adjacent CJK character pairs."""
    low = F.lower(t)
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1)), lambda x: F.length(x) >= 2)
    pairs = F.when(F.length(t) >= 2, F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))), lambda x: x.rlike(f"^[{CJK}]{{2}}$"))).otherwise(F.array().cast("array<string>"))
    # Character pairs are only looked for where there is a CJK character at all.
    pairs = F.when(t.rlike(f"[{CJK}]"), pairs).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


class _Places(dict):
    """A number for each word, in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def hash_code(rows: DataFrame, id_col: str, text_col: str, bits: int = 4096, hashes: int = 3, keep: int = 204) -> DataFrame:
    """(id, code): bits of the words' hashes, those met most often, ascending; ties at the last place all stay. Only bits that were met
    count, so a short text has a short code. Texts without a word have no row; texts of one id count as one.

    Counted where the texts lie, some texts at a time in one table of counts, and a word is hashed once for a task: no row is made for a word.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    low = rows.select(id_col, F.lower(text_col).alias("_t")).filter("_t is not null")
    if low.groupBy(id_col).count().filter("count > 1").take(1):
        low = low.groupBy(id_col).agg(F.array_join(F.collect_list("_t"), " ").alias("_t"))
    at_once = max(1, CELLS // bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = _Places(), np.zeros((0, hashes), np.int64)
        for b in (b.slice(i, at_once) for b in batches for i in range(0, b.num_rows, at_once)):
            words, ends = [], []
            for t in b.column(1).to_pylist():
                words += t.split()  # at blanks of any script, as BLANK
                ends.append(len(words))
            word = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
            new = [[int.from_bytes(hashlib.md5(f"{w}_{h}".encode()).digest()[-4:], "big") % bits for h in range(hashes)] for w in itertools.islice(places, len(table), None)]
            table = np.concatenate([table, np.array(new, np.int64).reshape(-1, hashes)])
            cells = np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0))[:, None] * bits + table[word]
            if len(places) > WORDS:
                places, table = _Places(), table[:0]
            met = np.bincount(cells.ravel(), minlength=b.num_rows * bits).reshape(-1, bits)
            least = np.partition(met, -min(keep, bits), axis=1)[:, -min(keep, bits), None]
            row, bit = np.nonzero(met >= np.maximum(least, 1))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            code = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bit, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), code], names=[id_col, "code"]).filter(pa.array(np.diff(ends) > 0))

    return low.mapInArrow(run, f"`{id_col}` {kind}, code array<long>")


def is_junk(t: Column) -> Column:
    """Mostly symbols: under 45 % or fewer than 4 ASCII letters, digits or CJK characters."""
    # Counted once, and compared without a division: inside a lambda nothing is shared. Single signs are one look-up for a character, ranges one each.
    good = F.length(F.regexp_replace(t, f"[^{string.ascii_letters}{string.digits}{CJK}]+", ""))
    return F.coalesce(good * 20 < F.greatest(F.length(t) * 9, F.lit(80)), F.lit(True))


def state_key(k: Column) -> Column:
    """Without blanks around it, case folded; empty is null."""
    return F.nullif(folded(_strip(k)), F.lit(""))


def folded(x: Column) -> Column:
    """Case folding: what differs by case only becomes one text (ß is ss, a final sigma a sigma, a dotless i stays). Cherokee
    becomes small letters, where Unicode folds to capitals."""
    kept = "\ue000"  # a private character in the place of the dotless i
    low = F.lower(F.upper(F.replace(x, F.lit("ı"), F.lit(kept))))
    for a, b in (("ς", "σ"), ("ß", "ss"), (kept, "ı")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return low


def chunks(t: Column, least: int = 10, most: int = 120) -> Column:
    """Sentences; long ones repacked at commas; a short piece joins the piece before unless that one is finished.

    Linear in the text: sentences end by a line break put after each mark, a long sentence is packed by one pattern (the longest head of at most ``most``
    characters that ends at a comma, else the whole head up to its comma; no part of it goes back over what it has passed, but for the comma), and whether a
    piece joins depends only on its length and the last character before.
    """
    lines = functools.reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit(mark + "\n")), ENDS, t)
    sentences = F.filter(F.transform(F.split(lines, "\n"), _strip), lambda x: x != "")

    def packed(p: Column, commas: str) -> Column:
        packs = rf"(?s).{{1,{most}}}+\z|.{{0,{most - 1}}}[{commas}]|[^{commas}]*+[{commas}]|[^{commas}]++"
        return F.regexp_extract_all(F.regexp_replace(p, f"([{commas}])[{BLANK}]+", "$1"), F.lit(packs), F.lit(0))

    def repack(p: Column) -> Column:
        # A class of ASCII commas alone is one look-up for a character, the whole class five.
        plain, others = (functools.reduce(Column.__or__, (F.contains(p, F.lit(c)) for c in COMMAS if c.isascii() == ascii_)) for ascii_ in (True, False))
        return F.when(F.length(p) <= most, F.array(p)).when(others, packed(p, COMMAS)).when(plain, packed(p, PLAIN_COMMAS)).otherwise(F.array(p))

    repacked = F.flatten(F.transform(sentences, repack))
    # An array of one gives the pieces a name, so that they are found once and not wherever they are used.
    return F.flatten(F.transform(F.array(repacked), lambda p: _joined(p, least)))


def _joined(p: Column, least: int) -> Column:
    joins = lambda x, i: (i > 0) & (F.length(x) < least) & ~F.get(p, i - 1).rlike(rf"[{ENDS}…]\z")
    # No piece holds a line break, so one marks where a piece starts anew: joining and splitting are linear, slices would copy all pieces for each.
    whole = F.array_join(F.transform(p, lambda x, i: F.when(joins(x, i), x).otherwise(F.concat(F.lit("\n"), x))), "")
    return F.filter(F.transform(F.split(whole, "\n"), _strip), lambda x: x != "")


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def has_credential(t: Column) -> Column:
    """Any credential mark or pattern."""
    found = F.lit(False)
    for mark in CREDENTIAL_MARKS:
        found = found | t.contains(mark)
    for pattern in (*CREDENTIAL_PATTERNS, LONG_TOKEN):
        found = found | t.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def redacted(t: Column) -> Column:
    """struct(text, hits): patterns, then marks, replaced."""
    whole, hits = t, F.lit(0)
    for pattern in (*CREDENTIAL_PATTERNS, LONG_TOKEN):
        hits = hits + F.regexp_count(t, F.lit(pattern))
        t = F.regexp_replace(t, pattern, "[REDACTED]")
    for mark in CREDENTIAL_MARKS:
        hits = hits + F.regexp_count(t, F.lit(mark))
        t = F.replace(t, F.lit(mark), F.lit("[REDACTED]"))
    # The chain names its text once for each step, so it is only gone through where there is anything to find.
    none = F.struct(whole.alias("text"), F.when(whole.isNotNull(), F.lit(0)).cast("long").alias("hits"))
    return F.when(has_credential(whole), F.struct(t.alias("text"), hits.cast("long").alias("hits"))).otherwise(none)


def app_slug(v: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(v, F.lit("")))), r"[^a-z0-9_.-]+", "-"), r"^[-._]+|[-._]+$", ""), F.lit(32))


def apps(tags: Column) -> Column:
    """All app tags joined by +, else ``legacy``."""
    own = F.transform(F.filter(tags, lambda x: x.startswith("app:")), lambda x: x.substr(F.lit(5), F.length(x)))
    return F.when(F.size(own) > 0, F.array_join(own, "+")).otherwise("legacy")


def first_tag(tags: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the first such tag, else the empty string."""
    own = F.filter(tags, lambda x: x.startswith(prefix))
    first = F.try_element_at(own, F.lit(1))
    return F.coalesce(first.substr(F.lit(len(prefix) + 1), F.length(first)), F.lit(""))


def cut(t: Column, n: int) -> Column:
    """``n`` characters, ended after the last sentence mark in the second half: the first kind of mark found decides."""
    head = F.left(t, F.lit(n))
    ends = []
    for mark in CUT_MARKS:
        at = F.lit(n) - F.locate(mark, F.reverse(head))  # 0-based place of the last one
        ends.append(F.when((F.locate(mark, head) > 0) & (at >= n * 0.5), F.left(head, at + 1)))
    return F.when(F.length(t) <= n, t).otherwise(F.coalesce(*ends, head))


def age_label(ts: Column, now: float) -> Column:
    """Age in seconds, minutes, hours or days, and the UTC month and day."""
    dt = F.lit(now) - ts
    day = F.date_format(F.timestamp_add("SECOND", ts.cast("int"), F.lit("1970-01-01").cast("timestamp_ntz")), "MM-dd")
    return F.when(dt < 90, F.concat(F.lit("just now ("), day, F.lit(")"))).when(dt < 3600, F.format_string("%dm ago (%s)", F.floor(dt / 60), day)).when(dt < 86400, F.format_string("%dh ago (%s)", F.floor(dt / 3600), day)).otherwise(F.format_string("%dd ago (%s)", F.floor(dt / 86400), day))


def route(q: Column, whole_words: bool = False) -> Column:
    """Question type by keyword, first match in a fixed order. By default inside words too, as the rule states."""
    low, out = F.lower(q), None
    for name, words in ROUTES:
        hit = F.lit(False)
        for w in words:
            hit = hit | (low.rlike(rf"\b{w}\b") if whole_words else low.contains(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("lookup")


def plain(t: Column) -> Column:
    """Blanks collapsed, trimmed, lowered: the key of exact repeats."""
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def dated(s: Column) -> Column:
    """``YYYY/MM/DD (Day) HH:MM`` to epoch seconds (UTC); no time means midnight; no date is null."""
    day = F.regexp_extract(s, r"(\d{4}/\d{2}/\d{2})", 1)
    clock = F.regexp_extract(s, r"(\d{2}:\d{2})", 1)
    return F.unix_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(clock == "", "00:00").otherwise(clock), F.lit("Z")), F.lit("yyyy/MM/dd HH:mmXXX"))).cast("double")


def top_sim(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"\[#(\d+)\s*\|\s*([0-9.]+)", 2), F.lit("")).cast("double")


def without_tags(t: Column, name: str) -> Column:
    """Wrapper tags of ``name`` made harmless."""
    return F.regexp_replace(t, rf"(?i)<(/?\s*{name}\s*>)", "&lt;$1")


def low_confidence(sims: Column, floor: float = 0.40, margin: float = 0.12) -> Column:
    """Best under the floor and not clearly ahead; a lone hit has no margin; no hits: false."""
    s = F.sort_array(sims, asc=False)
    gap = F.when(F.size(s) > 1, F.element_at(s, 1) - F.element_at(s, 2)).otherwise(0.0)
    return F.when(F.size(s) == 0, False).otherwise((F.element_at(s, 1) < floor) & (gap < margin))


def admits_prompt(t: Column) -> Column:
    """False for prompts that are too short, system notices, automation dispatches, or hold a credential mark."""
    head = F.left(F.ltrim(t), F.lit(200))
    bad = (F.length(t) < 2) | head.startswith("<system-reminder") | head.contains("Continue working toward the active session goal") | head.contains("AUTOMATION-DISPATCH:")
    for mark in (*CREDENTIAL_MARKS, "pypi-"):
        bad = bad | t.contains(mark)
    return F.coalesce(~bad, F.lit(False))


def session_of(tag: Column) -> Column:
    return F.regexp_replace(tag, r"_[0-9]+$", "")


def needle_words(t: Column) -> Column:
    """Distinct alphabetic words that aren't stop words, sorted."""
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda x: x.rlike(r"^[\p{L}]+$"))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))))


def squeezed(t: Column, n: int = 18) -> Column:
    return F.left(F.regexp_replace(t, r"\s+", ""), F.lit(n))


def source_weight(source: Column) -> Column:
    out = None
    for name, w in SOURCE_WEIGHT.items():
        out = F.when(source == name, w) if out is None else out.when(source == name, w)
    return out.otherwise(1.0)


def decay_weight(last_accessed: Column, access_count: Column, source: Column, now: float, tau: float) -> Column:
    """Power-law decay with rehearsal, at most 1; entries stored by a model fade half as fast."""
    own = F.when(source == "model", 2 * tau).otherwise(tau)
    return F.least(F.pow(1 + (F.lit(now) - last_accessed) / own, F.lit(-0.5)) * (1 + 0.5 * F.log2(1 + access_count)), F.lit(1.0))
