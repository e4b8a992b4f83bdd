"""Personal data: high-recall generators propose overlapping spans, boosted trees score them from format and
context, and calibrated thresholds choose which are added to the base spans.

The base spans (email, ip, card, phone) are leftmost, non-overlapping matches per kind that pass their
check; they always stay. Generators also propose what the base patterns miss: numbers without a country
sign, other separators, spelled-out addresses. The trees are fitted on the labelled candidates of all documents, every one of
them, as counted rows: base spans and format-preserving variants of them are positive, failed checks, wrong borders and digits
inside longer tokens negative. A quarter of the candidates, told by hashes, sets the thresholds.

Defined results: null text counts as empty; empty texts have no spans; repeated rows are scored each on its
own; of overlapping proposals of equal score the longest, then the first is taken; with too few examples to fit, nothing is added;
an empty table gives an empty result; all scans are linear, so very long texts and digit runs cost in proportion.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, strings, summed, table, tidy

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
#: Bins of a feature, the whole number that stands for a gradient of one, and steps of a threshold.
BINS, ONE, STEPS = 16, 1 << 20, 1 << 12
#: Different binned rows that are fitted in the driver; more are summed where they lie, with the same result.
HELD = 100_000
#: Different rows that a task counts before it hands them on.
COUNTED = 50_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_REGION = re.compile(r"[0-9+][0-9.()+\x20-]*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[(]\s?dot\s?[\])]|\.)\s?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_SPACED_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\s{1,2}(?:at|@)\s{1,2}|\s@|@\s)[A-Za-z0-9-]{1,63}(?:(?:\s{1,2}dot\s{1,2}|\s?\.\s?|\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_SPACED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?|\s{1,2}dot\s{1,2}|\s\.\s?|\.\s)[0-9]{1,3}){3}(?![0-9])", re.I)
_DIGITS, _GROUP = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
_BEFORE, _AFTER = re.compile(r"(\+?)[0-9]+([\x20().+-]{1,3})$"), re.compile(r"()([\x20().+-]{1,3})[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Base emails, found from each ``@``: the local part is the run to its left, so the scan is linear."""
    out, last, p = [], 0, text.find("@")
    while p != -1:
        s = p
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append((s, last := m.end()))
        p = text.find("@", m.end() if m else p + 1)
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Maximal runs of number characters; every base ip, card and phone lies inside one."""
    return [m.span() for m in _REGION.finditer(text)]


def ips(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Matches of four digit groups joined by single dots in a region, from its digit groups: a group that doesn't begin such
    a chain can't begin one at a later digit either, so the scan is linear."""
    groups = [m.span() for m in _GROUP.finditer(text, a, b)]
    joined = [text[x[1] : y[0]] == "." for x, y in zip(groups, groups[1:], strict=False)]
    out, i = [], 0
    while i + 3 < len(groups):
        if joined[i] and joined[i + 1] and joined[i + 2]:
            out.append((groups[i][0], groups[i + 3][1]))
            i += 4
        else:
            i += 1
    return out


def base_spans(text: str, failed: list[tuple[int, str, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind. ``failed`` gets the matches that fail their check."""
    out = [(s, 0, e) for s, e in emails(text)]
    for a, b in regions(text):
        if b - a < 7:
            continue
        found = [(x, 1, y) for x, y in ips(text, a, b)] if text.count(".", a, b) > 2 else []
        found += [(m.start(), k, m.end()) for k, pattern in ((2, _CARD), (3, _PHONE)) for m in pattern.finditer(text, a, b)]
        for s, k, e in found:
            n = sum(map(len, _GROUP.findall(text, s, e))) if k > 1 else 0
            fine = octets(text[s:e]) if k == 1 else 14 <= n <= 19 and luhn("".join(_GROUP.findall(text, s, e))) if k == 2 else 10 <= n <= 15
            if fine:
                out.append((s, k, e))
            elif failed is not None:
                failed.append((s, k, e))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping candidates (start, kind number, end) beyond the base patterns: every run of whole digit groups of a number
    region whose digits fit a kind (a plus only at its start; at most 19 digits, so linear in the text): phones without a plus,
    cards with any separators, addresses beside other numbers; spelled-out, bracketed and spaced emails and addresses."""
    out = []
    for a, b in regions(text):
        if b - a < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, a, b)]
        for i, (start, _) in enumerate(groups):
            n, dotted = 0, True
            for j in range(i, len(groups)):
                s, e = groups[j]
                gap = text[groups[j - 1][1] : s] if j > i else "."
                n, dotted = n + e - s, dotted and gap == "."
                if "+" in gap or n > 19 and (not dotted or j - i > 3):
                    break
                if dotted and j - i == 3 and octets(text[start:e]):
                    out.append((start, 1, e))
                first = text[start - 1 : start] if start else ""
                lead = start - (first == "+" or first == "(" and ")" in text[start:e])
                if 7 <= n <= 15:
                    out.append((lead, 3, e))
                if 13 <= n <= 19:
                    out.append((start if first == "+" else lead, 2, e))
    low = text.lower()
    if any(x in low for x in ("at)", "at]", "at )", "at ]")):
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if "@ " in text or " @" in text or " at " in low and (" dot " in low or "dot)" in low or "dot]" in low):
        out += [(m.start(), 0, m.end()) for m in _SPACED_MAIL.finditer(text)]
    if "dot" in low or " ." in text or ". " in text or "[.]" in text or "(.)" in text:
        out += [(m.start(), 1, m.end()) for m in _SPACED_IP.finditer(text)]
    return out


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 4 if c in "\"'=:/" else 3


def _beside(m: re.Match[str] | None) -> tuple[float, float, float]:
    """Whether another number stands next to a candidate, whether more than spaces joins them, and whether it has a plus."""
    return (1.0, float(not m.group(2).isspace()), float(m.group(1) == "+")) if m else (0.0, 0.0, 0.0)


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of a candidate."""
    s, k, e = span
    seg = text[s:e]
    groups = _GROUP.findall(seg)
    digits, seps = "".join(groups), [c for c in seg if not c.isalnum()]
    before, after = text[max(0, s - 24) : s], text[e : e + 24]
    word = re.search(r"([^\W\d_]+)\W*$", before)
    return [
        *(float(k == i) for i in range(4)),
        len(digits), len(seg), len(seps), len(set(seps)), float("(" in seg), float(seg[:1] == "+"),
        max(map(len, groups), default=0), len(groups), len(groups[-1]) if groups else 0, len(groups[0]) if groups else 0,
        float(len(digits) >= 13 and luhn(digits)), float(seg.count(".") == 3 and octets(seg.strip(".")) if digits and set(seg) <= set("0123456789.") and "" not in seg.split(".") else 0),
        _class(text[s - 1 : s]), _class(text[e : e + 1]), float(bool(re.search(r"[0-9A-Za-z]$", before))), float(bool(re.match(r"[0-9A-Za-z]", after))),
        *_beside(_BEFORE.search(before[-8:])), *_beside(_AFTER.match(after)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), len(re.findall(r"dot|\.", seg, re.I)), len(re.findall(r"[\[(]", seg)), float(bool(re.search(r"\sat\s", seg))), float(bool(re.search(r"\sdot\s", seg))),
        len(word.group(1)) if word else 0, float("@" in seg), float(bool(re.search(r"[\[(]\s?at", seg, re.I))), len(re.search(r"[A-Za-z]*$", seg).group()),
    ]


class Trees:
    """Gradient-boosted regression trees on the logistic loss over quantile bins; plain numpy.

    ``cuts``: the edges of each feature's bins. ``sums(trees, level)``: gradients, curvatures and examples summed by node of the last
    tree's ``level``, feature and bin. They are whole numbers, so neither the order nor the tasks that add them up change a tree.
    """

    def __init__(self, cuts: list[np.ndarray], share: float, sums: Callable[[Trees, int], np.ndarray], *, rounds: int = 30, depth: int = 3, rate: float = 0.3):
        self.cuts, self.depth, self.base = cuts, depth, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        #: Of each tree: features and bins of the nodes, the edges that the bins end at, values of the leaves.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            feature, last, edge, value = np.zeros(2**depth, int), np.full(2**depth, BINS), np.full(2**depth, np.inf), np.zeros(2 ** (depth + 1))
            self.trees.append((feature, last, edge, value))
            for level in range(depth):
                got = sums(self, level)
                for at, own in enumerate(got, 2**level):
                    whole, left = own[0].sum(axis=0), own.cumsum(axis=1)[:, :-1]
                    g, h = left[..., 0] / ONE, left[..., 1] / ONE
                    gt, ht = whole[:2] / ONE
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    j, i = divmod(int(gain.argmax()), BINS - 1)
                    sides = (whole, 0 * whole)
                    if whole[2] >= 4 and gain[j, i] > 1e-6 and i < len(cuts[j]):
                        feature[at], last[at], edge[at], sides = j, i, cuts[j][i], (left[j, i], whole - left[j, i])
                    if level == depth - 1:
                        value[2 * at : 2 * at + 2] = [-rate * float(w[0]) / (float(w[1]) + ONE) for w in sides]

    def nodes(self, x: np.ndarray, feature: np.ndarray, edge: np.ndarray, levels: int) -> np.ndarray:
        node = np.ones(len(x), int)
        for _ in range(levels):
            node = 2 * node + (x[np.arange(len(x)), feature[node]] > edge[node])
        return node

    def score(self, x: np.ndarray, trees: list | None = None) -> np.ndarray:
        """Of rows of features, or of bins (bytes)."""
        z, bins = np.full(len(x), self.base), x.dtype == np.uint8
        for feature, last, edge, value in self.trees if trees is None else trees:
            z += value[self.nodes(x, feature, last if bins else edge, self.depth)]
        return 1 / (1 + np.exp(-z))

    def steps(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Counts of binned rows by kind, step of their score and label."""
        step = np.minimum(self.score(x) * STEPS, STEPS - 1).astype(int)
        return np.bincount((kind * STEPS + step) * 2 + (y > 0), weights=n, minlength=2 * len(KINDS) * STEPS).astype(np.int64).reshape(len(KINDS), STEPS, 2)

    def sums(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, level: int) -> np.ndarray:
        """What ``sums`` of the class asks for, of binned rows with their labels and counts: node, feature, bin by three."""
        p = self.score(x, self.trees[:-1])
        node = self.nodes(x, *self.trees[-1][:2], level) - 2**level
        each = [np.rint((p - y) * ONE) * n, (np.rint(p * (1 - p) * ONE) + 1) * n, n]
        out = np.zeros((2**level, x.shape[1], BINS, 3), np.int64)
        for j in range(x.shape[1]):
            cell = node * BINS + x[:, j]
            for c, w in enumerate(each):
                out[:, j, :, c] = np.bincount(cell, weights=w, minlength=2**level * BINS).reshape(-1, BINS)
        return out


def binned(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The bins of rows of features, as bytes."""
    return np.column_stack([np.searchsorted(edges, x[:, j], side="left") for j, edges in enumerate(cuts)]).astype(np.uint8)


def _places(n: int) -> list[int]:
    """Places of the quantiles, the lower ones, of ``n`` sorted values."""
    return sorted(set(np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (n - 1)).astype(int).tolist()))


def _variants(text: str, s: int, k: int, e: int) -> list[tuple[str, tuple[int, int, int], int]]:
    """Texts in which a base span is written otherwise, with the span to be found and its label."""
    seg, out = text[s:e], []
    if k == 3:
        bare = re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", seg)
        if len(_DIGITS.findall(bare)) >= 7 and bare[0] in "(0123456789":
            dashed = "-".join(_GROUP.findall(bare))
            out += [(text[:s] + x + text[e:], (s, 3, s + len(x)), 1) for x in dict.fromkeys((bare, dashed))]
        plain = "".join(_GROUP.findall(seg))
        out.append((text[:s] + "a" + plain + "f" + text[e:], (s + 1, 3, s + 1 + len(plain)), 0))
    elif k == 2:
        digits = "".join(_GROUP.findall(seg))
        spread = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        out.append((text[:s] + spread + text[e:], (s, 2, s + len(spread)), 1))
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        out.append((text[:s] + wrong + text[e:], (s, 2, s + len(wrong)), 0))
    elif k == 1:
        parts = seg.split(".")
        for dot in ("[.]", " [dot] ", " dot ", " . ", "(dot)"):
            other = dot.join(parts)
            out.append((text[:s] + other + text[e:], (s, 1, s + len(other)), 1))
            wrong = dot.join([str(int(parts[0][-3:]) + 300)[-3:], *parts[1:]])
            if int(wrong.split(dot)[0]) > 255:
                out.append((text[:s] + wrong + text[e:], (s, 1, s + len(wrong)), 0))
    elif k == 0 and "@" in seg:
        spelled = seg.replace("@", " [at] ", 1)
        out.append((text[:s] + spelled + text[e:], (s, 0, s + len(spelled)), 1))
        for at, dot in ((" at ", " dot "), (" @ ", "."), ("@ ", " . "), (" (at) ", " (dot) ")):
            other = seg.replace("@", at, 1).replace(".", dot) if dot != "." else seg.replace("@", at, 1)
            if "." not in seg.split("@")[0] or dot == ".":
                out.append((text[:s] + other + text[e:], (s, 0, s + len(other)), 1))
        bare = seg.replace("@", " at ", 1)  # words after an "at" whose full stop ends a sentence
        out.append((text[:s] + bare + text[e:], (s, 0, s + len(bare)), 0))
        shorter = seg.split("@")[0] + " (at) " + seg.split("@")[1].split(".")[0]
        out.append((text[:s] + shorter + text[e:], (s, 0, s + len(shorter)), 0))
    return out


def _beside_numbers(text: str, s: int, k: int, e: int) -> list[tuple[str, tuple[int, int, int]]]:
    """Texts in which a base ip, card or phone has another number before or after it, with the span to be found."""
    seg = text[s:e]
    digits = "".join(_GROUP.findall(seg))
    small = str(int(digits[-3:]) % 97)
    other = digits[::-1] if k == 2 else ".".join(str(int(digits[i : i + 2]) + 100) for i in range(0, 8, 2)) if k == 3 else small
    after = [(f"{text[:s]}{seg} {x}{text[e:]}", (s, k, e)) for x in dict.fromkeys((small, other))]
    return [*after, (f"{text[:s]}{small} {seg}{text[e:]}", (s + len(small) + 1, k, e + len(small) + 1))]


def examples(text: str) -> list[tuple[list[float], int]]:
    """Labelled candidates of a text: base spans and variants positive; failed checks, wrong borders and digits inside tokens negative."""
    failed: list[tuple[int, int, int]] = []
    base = base_spans(text, failed)
    out = [(describe(text, x), 1) for x in base] + [(describe(text, x), 0) for x in failed]
    for s, k, e in base:
        out += [(describe(t, span), label) for t, span, label in _variants(text, s, k, e)]
        spelled = [(text, (s, k, e)), *((t, span) for t, span, label in _variants(text, s, k, e) if label)]
        for t, span in [y for t, x in spelled for y in _beside_numbers(t, *x)] if k else ():
            out.append((describe(t, span), 1))
            out += [(describe(t, x), 0) for x in proposals(t) if x != span and x[0] < span[2] and span[0] < x[2]]
    for s, k, e in proposals(text):
        over = [x for x in base if x[0] < e and s < x[2]]
        if over and all((s, k, e) != x for x in over):
            out.append((describe(text, (s, k, e)), 0))
        elif not over and re.search(r"[0-9A-Za-z]$", text[max(0, s - 1) : s]):
            out.append((describe(text, (s, k, e)), 0))
    return out


class Detector:
    """Trees and one threshold per kind: the lowest step that keeps ``precision`` on a validation part; 2 adds nothing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION):
        """Fitted on the examples at hand, of which every fourth is in the validation part."""
        self.trees, self.threshold = None, [2.0] * len(KINDS)
        if len(y) < 50 or not 0 < y.sum() < len(y):
            return
        check, n = np.arange(len(y)) % 4 == 0, np.ones(len(y))
        cuts = [np.unique(c) for c in np.sort(x[~check], axis=0)[_places(int((~check).sum()))].T]
        b, kind = binned(cuts, x), x[:, : len(KINDS)].argmax(axis=1)
        self.fit(Trees(cuts, y[~check].mean(), lambda t, level: t.sums(b[~check], y[~check], n[~check], level)), lambda t: t.steps(b[check], y[check], n[check], kind[check]), precision)

    def fit(self, trees: Trees, steps: Callable[[Trees], np.ndarray], precision: float = PRECISION) -> Detector:
        """Thresholds for ``trees``, by their ``steps`` over the validation part."""
        self.trees = trees
        for k, own in enumerate(steps(trees)):
            wrong, right = own[::-1].cumsum(axis=0)[::-1].T  # from the step on
            fine = np.flatnonzero((own.sum(axis=1) > 0) & (right >= precision * (right + wrong)) & (np.arange(STEPS) >= STEPS // 2))
            if len(fine) and right[0] >= 5:
                self.threshold[k] = max(0.8, float(fine[0] / STEPS))
        return self

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Proposals over their threshold that overlap no base span; of overlapping ones the likeliest, then the longest."""
        if self.trees is None:
            return []
        covered = bytearray(len(text))
        for s, _, e in base:
            covered[s:e] = b"\1" * (e - s)
        free = [x for x in proposals(text) if covered.find(1, x[0], x[2]) < 0]
        if not free:
            return []
        p = self.trees.score(np.array([describe(text, x) for x in free]))
        taken: list[tuple[int, int, int]] = []
        for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i][0] - free[i][2], free[i])):
            s, k, e = free[i]
            if p[i] >= self.threshold[k] and covered.find(1, s, e) < 0:
                taken.append(free[i])
                covered[s:e] = b"\1" * (e - s)
        return taken


def in_check(seed: int, i: int) -> bool:
    """Whether the ``i``-th example of a text, whose digest is ``seed``, is in the validation part."""
    import xxhash

    return xxhash.xxh3_64_intdigest(str(i), seed=seed) % 4 == 0


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(x, y, c, n): how often each different example (features, label, whether it is in the validation part) stands in all documents."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[bytes, int, bool]] = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*((*x, n) for x, n in held.items()), strict=True)) or [[]] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], names=["x", "y", "c", "n"])

        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), strings(b, "text"), strict=True):
                for i, (f, y) in enumerate(examples(t)):
                    if not i:
                        seed = xxhash.xxh3_64_intdigest(f"{doc}:{t}".encode("utf-8", "replace"))
                    held[np.array(f, "<f4").tobytes(), y, in_check(seed, i)] += 1
                    if len(held) >= COUNTED:
                        yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "x binary, y int, c boolean, n long").groupBy("x", "y", "c").agg(F.sum("n").alias("n"))


def _rows(batch: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype).reshape(batch.num_rows, -1)


def _cuts(rows: DataFrame, total: int) -> list[np.ndarray]:
    """The edges of each feature's bins: the lower quantiles of ``rows`` (x, n), ``total`` with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy()
            for j, column in enumerate(_rows(b, "x", "<f4").T if b.num_rows else ()):
                v, which = np.unique(column, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v), pa.array(np.bincount(which, weights=n).astype(np.int64))], names=["j", "v", "n"])

    values = rows.select("x", "n").mapInArrow(tidy(run), "j int, v float, n long").groupBy("j", "v").agg(F.sum("n").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("v")))  # a feature has few different values
    places = F.array(*(F.lit(x).cast("long") for x in _places(total)))
    cuts: list[list[float]] = [[] for _ in describe("", (0, 0, 0))]
    for r in upto.filter(F.exists(places, lambda x: (x >= F.col("upto") - F.col("n")) & (x < F.col("upto")))).collect():
        cuts[r.j].append(r.v)
    return [np.array(sorted(c)) for c in cuts]


def _added_up(rows: DataFrame, what: Callable[..., np.ndarray]) -> dict[int, np.ndarray]:
    """``what`` of ``rows`` (b, y, n, k), summed over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = what(_rows(b, "b", "u1"), *(b.column(c).to_numpy().astype(float) for c in "yn"), b.column("k").to_numpy())
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["chunk", "part", "payload"])

    return summed(rows.mapInArrow(tidy(run), "chunk int, part int, payload binary"), "<i8", decode=zlib.decompress)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Fit on all candidates of all documents. They are counted by their features, then by their bins, and the trees ask only for sums
    over counted rows: up to ``HELD`` different rows are held by the driver, more are summed in the tasks, once for each level of a tree."""
    none = Detector(np.zeros((0, 0)), np.zeros(0))
    counted = cut(_counted(docs, id_col, text_col), spent=True)
    n = {(r.c, r.y): r.n for r in counted.groupBy("c", "y").agg(F.sum("n").alias("n")).collect()}
    fitted, right = n.get((False, 0), 0) + n.get((False, 1), 0), n.get((False, 1), 0)
    if sum(n.values()) < 50 or not 0 < right < fitted:
        return none
    cuts = _cuts(counted.filter("not c"), fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _rows(b, "x", "<f4")
                cols = [pa.array([r.tobytes() for r in binned(cuts, x)], pa.binary()), pa.array(x[:, : len(KINDS)].argmax(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(c) for c in "ycn")], names=["b", "k", "y", "c", "n"])

    rows = cut(counted.mapInArrow(tidy(run), "b binary, k int, y int, c boolean, n long").groupBy("b", "k", "y", "c").agg(F.sum("n").alias("n")), spent=True)
    if rows.count() <= HELD:
        got = rows.collect()
        b, c = np.frombuffer(b"".join(bytes(r.b) for r in got), "u1").reshape(len(got), -1), np.array([r.c for r in got])
        y, n, k = (np.array([r[x] for r in got], t) for x, t in (("y", float), ("n", float), ("k", int)))
        sums = lambda t, level: t.sums(b[~c], y[~c], n[~c], level)
        steps = lambda t: t.steps(b[c], y[c], n[c], k[c])
    else:
        sums = lambda t, level: _added_up(rows.filter("not c"), lambda b, y, n, k: t.sums(b, y, n, level))[0].reshape(2**level, -1, BINS, 3)
        steps = lambda t: _added_up(rows.filter("c"), t.steps).get(0, np.zeros(2 * len(KINDS) * STEPS, np.int64)).reshape(len(KINDS), STEPS, 2)
    return none.fit(Trees(cuts, right / fitted, sums), steps)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for s, k, e in sorted(spans):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, detector: Detector, *, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all spans, and the redacted text if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans", *(["redacted"] if redact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in strings(b, "text"):
                base = base_spans(t)
                every = base + (more := shared.value.added(t, base))
                rows.append((*(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more), len(every), *([redacted(t, every)] if redact else [])))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names[1:]]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long" + ", redacted string" * redact
    return rows.mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs))
