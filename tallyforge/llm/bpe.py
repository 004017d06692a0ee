"""BPE by speculation: greedy longest match, pair checks, exact merging only where they fail.

A piece's tokens are first guessed by taking the longest token that its rest begins with. By a
property of rank-ordered merging, a guess is the true encoding exactly if each adjacent pair of
its tokens, merged by itself, stays that pair: the first merge that crossed a boundary would also
cross it in the pair alone. All adjacent pairs of a batch are looked up at once in a bounded
direct-mapped table of known verdicts; unknown pairs are merged once and entered. Only pieces with
a failing pair are merged exactly.

Nulls: a null text is the empty text, with no tokens. Texts of any length are coded whole; white
space alone gives no tokens. A tokenizer of another form than byte-level BPE is refused with an error. Rows that repeat give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts
from .tokens import WordIds, byte_letters, default_tokenizer, load, settings

#: Slots of the table of pair verdicts, a power of two.
PAIR_SLOTS = 1 << 20
UNKNOWN, GOOD = -1, 1
#: Pieces of more symbols are merged with a heap.
SHORT = 48
NEVER = 1 << 40


class SpeculativeCoder:
    """Ids of pieces (see ``tokens.PIECES``), a letter for each byte, for a byte-level BPE with a word-end suffix."""

    def __init__(self, path: str, slots: int = PAIR_SLOTS):
        model = settings(path)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        alphabet = [x + s for x in byte_letters().values() for s in {"", self.suffix}]
        if any(x not in self.vocab for x in alphabet):
            raise ValueError("every byte must be a token, with and without the word end")
        self.text = {i: t for t, i in self.vocab.items()}
        self.mask = slots - 1
        self.keys = np.full(slots, -1, "i8")
        self.verdicts = np.zeros(slots, "i1")
        self.alone: dict[int, bool] = {}
        self.merged = 0

    def symbols(self, text: str, ends: bool) -> list[str]:
        return [*text[:-1], text[-1] + self.suffix] if ends else list(text)

    def exact(self, symbols: list[str]) -> list[int]:
        """Merges by rank, the leftmost of equal ranks first."""
        return self._exact_short(symbols) if len(symbols) <= SHORT else self._exact_long(symbols)

    def _exact_short(self, symbols: list[str]) -> list[int]:
        parts, get = list(symbols), self.ranks.get
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((parts[k - 1], parts[k]), NEVER)
            if k < len(ranks):
                ranks[k] = get((parts[k], parts[k + 1]), NEVER)
        return [self.vocab[p] for p in parts]

    def _exact_long(self, symbols: list[str]) -> list[int]:
        parts, ranks, n = list(symbols), self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k] if parts[k] is not None else n
            if j >= n or parts[k] != left or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [self.vocab[p] for p in parts if p is not None]

    def guess(self, piece: str) -> list[int]:
        out, at, n, vocab = [], 0, len(piece), self.vocab
        while True:
            if n - at <= self.longest and (i := vocab.get(piece[at:] + self.suffix)) is not None:
                out.append(i)
                return out
            for end in range(min(n - 1, at + self.longest), at, -1):
                if (i := vocab.get(piece[at:end])) is not None:
                    out.append(i)
                    at = end
                    break

    def _symbols_of(self, token: int) -> list[str]:
        text = self.text[token]
        ends = bool(self.suffix) and text.endswith(self.suffix) and len(text) > len(self.suffix)
        return self.symbols(text[: -len(self.suffix)] if ends else text, ends)

    def stays(self, token: int) -> bool:
        if token not in self.alone:
            self.alone[token] = self.exact(self._symbols_of(token)) == [token]
        return self.alone[token]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Verdicts of all pairs at once; pairs that the table lacks are merged and entered."""
        keys = (left << 32) | right
        slots = ((keys * 0x9E3779B97F4A7C1) >> 20) & self.mask
        out = np.where(self.keys[slots] == keys, self.verdicts[slots], UNKNOWN)
        if (out == UNKNOWN).any():
            new, place = np.unique(keys[out == UNKNOWN], return_inverse=True)
            found = np.array([self.exact(self._symbols_of(a) + self._symbols_of(b)) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)], "i1")
            out[out == UNKNOWN] = found[place]
            slots = ((new * 0x9E3779B97F4A7C1) >> 20) & self.mask
            self.keys[slots] = new
            self.verdicts[slots] = found  # where two new pairs share a slot, the last is kept in both
        return out == GOOD

    def ids(self, pieces: Sequence[str]) -> list[list[int]]:
        guesses = [self.guess(p) for p in pieces]
        sizes = np.fromiter(map(len, guesses), "i8", len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), "i8", int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, "i8")
        failing = set(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]].tolist()) if len(inner) else set()
        failing.update(k for k in np.flatnonzero(sizes == 1).tolist() if not self.stays(guesses[k][0]))
        self.merged += len(failing)
        for k in failing:
            guesses[k] = self.exact(self.symbols(pieces[k], True))
        return guesses


KINDS = {"n_tokens": "long", "token_ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _columns(path: str, wanted: tuple[str, ...], kinds: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        coder = WordIds(path, SpeculativeCoder(path))
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        decimal, strings = [str(i) for i in range(size)], [tokenizer.id_to_token(i) or "" for i in range(size)]
        joins = settings(path).get("decoder") is None
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out: dict[str, list] = {name: [] for name in wanted}
            for raw in coder.batch(texts(batch)):
                ids = np.frombuffer(raw, "<u4").tolist()
                if "n_tokens" in out:
                    out["n_tokens"].append(len(ids))
                if "token_ids" in out:
                    out["token_ids"].append(ids)
                if "ids_sha256" in out:
                    out["ids_sha256"].append(sha(" ".join([decimal[i] for i in ids])))
                if "decoded" in out or "decoded_sha256" in out:
                    text = " ".join([strings[i] for i in ids]) if joins else tokenizer.decode(ids, skip_special_tokens=False)
                    if "decoded" in out:
                        out["decoded"].append(text)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(sha(text))
            own = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, own.get(k, pa.string())) for k, v in out.items()]], ["doc_id", *out])

    return run


def encode_decode(docs: DataFrame, tokenizer: str | None = None, outputs: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """doc_id and the asked-for outputs: ``token_ids``, their number, the decoded text, and digests of both."""
    small_batches(docs.sparkSession)
    items = docs.select("doc_id", "text")
    schema = ", ".join([f"doc_id {items.schema['doc_id'].dataType.simpleString()}", *[f"{o} {KINDS[o]}" for o in outputs]])
    return items.mapInArrow(_columns(tokenizer or default_tokenizer(), tuple(outputs), pa.string()), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return encode_decode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
