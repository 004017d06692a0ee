"""Compiler indexes: a reader of their protobuf form, ranges and roles of occurrences, and the join with methods."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import ship

# Field numbers of the index's messages, and what an occurrence's role bits say.
DOCUMENT, EXTERNAL = 2, 3
DOC_PATH, DOC_OCCURRENCE, DOC_SYMBOL, DOC_LANGUAGE = 1, 2, 3, 4
OCC_RANGE, OCC_SYMBOL, OCC_ROLES = 1, 2, 3
SYM_NAME, SYM_DOC, SYM_KIND, SYM_DISPLAY = 1, 3, 5, 6
ROLES = ["definition", "import", "write", "read", "generated", "test", "forward_definition"]

ROWS = "index_id string, kind string, file_path string, language string, symbol string, range array<int>, roles int, display_name string, docs array<string>, error string"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = raw[at]
        out |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return out, at
        if shift > 63:
            raise ValueError("a number is too long")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields; only whole numbers and bytes carry something here."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(raw, at)
            yield number, value
        elif kind == 2:
            size, at = _varint(raw, at)
            if at + size > len(raw):
                raise ValueError("a field is cut")
            yield number, raw[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [_signed(value)]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(_signed(n))
    return out


def _signed(n: int) -> int:
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >= 1 << 31 else n


def _symbol(raw: bytes, index_id: str, path: str | None, language: str | None) -> tuple:
    name, display, docs = "", None, []
    for number, value in fields(raw):
        if number == SYM_NAME:
            name = value.decode()
        elif number == SYM_DISPLAY:
            display = value.decode()
        elif number == SYM_DOC:
            docs.append(value.decode())
    return (index_id, "symbol" if path else "external", path, language, name, None, None, display, docs, None)


def index_rows(index_id: str, raw: bytes, most_bytes: int) -> list[tuple]:
    """Documents, symbols and occurrences of one index as tagged rows; a broken or too large index is one row with its error."""
    bad = lambda why: [(index_id, "error", None, None, None, None, None, None, None, why)]
    if len(raw) > most_bytes:
        return bad(f"index of {len(raw)} bytes is over {most_bytes}")
    out: list[tuple] = []
    try:
        for number, value in fields(raw):
            if number == EXTERNAL:
                out.append(_symbol(value, index_id, None, None))
            elif number == DOCUMENT:
                parts = list(fields(value))
                path = next((v.decode() for n, v in parts if n == DOC_PATH), "").replace("\\", "/")
                language = next((v.decode() for n, v in parts if n == DOC_LANGUAGE), None)
                while path.startswith("./"):
                    path = path[2:]
                if not path or path.startswith("/") or ".." in path.split("/"):
                    return bad(f"document path {path!r}")
                out.append((index_id, "document", path, language, None, None, None, None, None, None))
                out += [_symbol(v, index_id, path, language) for n, v in parts if n == DOC_SYMBOL]
                for n, v in parts:
                    if n == DOC_OCCURRENCE:
                        span, symbol, roles = [], "", 0
                        for m, w in fields(v):
                            if m == OCC_RANGE:
                                span += _numbers(w)
                            elif m == OCC_SYMBOL:
                                symbol = w.decode()
                            elif m == OCC_ROLES:
                                roles = _signed(w)
                        out.append((index_id, "occurrence", path, language, symbol, span, roles, None, None, None))
    except (ValueError, IndexError, UnicodeDecodeError, AttributeError) as e:
        return bad(f"broken index: {e}")
    return out


def read_indexes(indexes: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """Rows of ``indexes`` (index_id, content): one task reads one index, which ``most_bytes`` bounds; see ``ROWS``."""
    ship(indexes.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, raw in zip(part.index_id, part.content, strict=True):
                yield pd.DataFrame(index_rows(i, bytes(raw), most_bytes), columns=[c.strip().split(" ")[0] for c in ROWS.split(",")])

    return indexes.select("index_id", "content").mapInPandas(run, ROWS)


def decoded_range(span: Column) -> Column:
    """Start and end of an occurrence from its three or four numbers, with an error for anything else: struct (start_line, start_char, end_line, end_char, error)."""
    n = F.size(span)
    at = lambda k: F.get(span, F.lit(k))
    end_line, end_char = F.when(n == 3, at(0)).otherwise(at(2)), F.when(n == 3, at(2)).otherwise(at(3))
    error = (
        F.when(~n.isin(3, 4) | span.isNull(), "range must have 3 or 4 numbers")
        .when(F.exists(span, lambda x: x < 0), "negative coordinate")
        .when((end_line < at(0)) | ((end_line == at(0)) & (end_char < at(1))), "inverted range")
    )
    good = lambda c, name: F.when(error.isNull(), c).alias(name)
    return F.struct(good(at(0), "start_line"), good(at(1), "start_char"), good(end_line, "end_line"), good(end_char, "end_char"), error.alias("error"))


def decoded_roles(bits: Column) -> Column:
    """Names of an occurrence's roles in their order, null for unknown bits."""
    known = (bits >= 0) & (bits < (1 << len(ROLES)))
    return F.when(known, F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, F.lit(r)) for k, r in enumerate(ROLES)])))


def method_symbols(methods: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each method with the one symbol that is defined in its file on its first line: (file_path, name, start_line, status, candidates, symbol).

    ``occurrences`` is (file_path, symbol, line, is_callable) of definitions; status is resolved, missing or ambiguous.
    """
    found = occurrences.where("is_callable").groupBy("file_path", F.col("line").alias("start_line")).agg(F.count_distinct("symbol").alias("candidates"), F.min("symbol").alias("one"))
    n = F.coalesce("candidates", F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous")
    return methods.join(found, ["file_path", "start_line"], "left").select("file_path", "name", "start_line", status.alias("status"), n.alias("candidates"), F.when(n == 1, F.col("one")).alias("symbol"))
