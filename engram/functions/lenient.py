"""Functions that need Python: lenient JSON, safe arithmetic, the offline embedder. Arrow batches, never row by row."""

from __future__ import annotations

import ast
import hashlib
import json
import operator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def safe_value(expr: str | None) -> float | None:
    """Arithmetic of numbers only; anything else is null."""

    def at(n: ast.AST) -> float:
        if isinstance(n, ast.Expression):
            return at(n.body)
        if isinstance(n, ast.Constant) and type(n.value) in (int, float):
            return n.value
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](at(n.left), at(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](at(n.operand))
        raise ValueError

    try:
        return float(at(ast.parse((expr or "").strip(), mode="eval")))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def lenient(text: str | None) -> str | None:
    """The first JSON object or array in a text, closed if it was cut off, as compact JSON; null if none."""
    text = text or ""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    body, stack, quoted, escaped, marks = text[at:], [], False, False, []
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            marks.append((i + 1, "".join(reversed(stack))))
            if not stack:
                break
    tries = [body[:i] + rest for i, rest in reversed(marks)]
    tries = [body + '"' * quoted + "".join(reversed(stack)), *tries] if stack else tries
    for t in tries:
        try:
            return json.dumps(json.loads(t), separators=(",", ":"), sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(DoubleType())
def arithmetic(s: pd.Series) -> pd.Series:
    return s.map(safe_value)


@F.pandas_udf(StringType())
def lenient_json(s: pd.Series) -> pd.Series:
    return s.map(lenient)


@F.pandas_udf(ArrayType(FloatType()))
def embed(tokens: pd.Series) -> pd.Series:
    """Offline hashing embedder over sorted tokens; any model with the same shape can stand in."""
    from ..operators.ingest import hash_embedding

    return tokens.map(lambda t: hash_embedding(list(t)).astype(np.float32))


@F.pandas_udf(ArrayType(DoubleType()))
def embed_double(tokens: pd.Series) -> pd.Series:
    """The same in double precision."""
    from ..operators.ingest import hash_embedding

    return tokens.map(lambda t: hash_embedding(list(t)))


@F.pandas_udf(BinaryType())
def embed_bits(tokens: pd.Series) -> pd.Series:
    """The set dimensions of the offline embedding, a bit each. A word is hashed once for a batch."""
    from ..operators.ingest import DIMS

    place: dict[str, int] = {}
    word = np.array([place.setdefault(w, len(place)) for t in tokens for w in t], np.int64)
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in place), np.uint8).reshape(-1, 16)
    dims = digests[:, [0, 4, 8]].astype(np.int64)  # the lowest byte of each number, as there are 256 dimensions
    row = np.repeat(np.arange(len(tokens)), tokens.map(len))
    bits = np.zeros((len(tokens), DIMS), bool)
    bits[row[:, None], dims[word]] = True
    return pd.Series([r.tobytes() for r in np.packbits(bits, axis=1)])
