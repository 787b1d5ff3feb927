"""BPE encoding and decoding with forced-boundary splitting.

A vocabulary fixes which pairs of neighbouring symbols occur inside any of its
tokens. A pair that occurs in none can never end up inside one token, whatever
merges are applied, so the text may be cut there: fragments are encoded
independently (and remembered), and the ids are concatenated. Within a fragment
merges are applied by rank from a heap, so a word of a million characters costs
n log n, not n squared.

The tokenizer file is data: its normaliser (NFC, white space to one space,
lower case), its word pattern, its byte alphabet and its word-end suffix are
honoured; the two special strings are cut out of the raw text first.

Where the library's Unicode tables differ from Python's, ``unicode_gaps`` says how.

Edge cases: a null text counts as empty (no ids, empty decoding); a very long text is
encoded run by run, and memory per task is bounded by one Arrow slice plus a bounded memo;
repeated rows get equal results; merges of one rank apply leftmost first; unknown ids in
decoding raise KeyError; extra columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re as _re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim
from .unicode_gaps import BARRIER, CAPITAL, FAR, GAP, HIGH, MARK, SMALL, STAND_IN

#: Remembered runs between white space, and as many words: about 250 bytes each for both.
MEMO = 400_000
MEMO_CHARS = 64
SHORT = 48
#: A merge's rank and new id in one number, so that the least number is the next merge.
ID_BITS = 32
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 2 * ID_BITS


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest for U+0100 and after, in order."""
    plain = {b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """An encoder and decoder for one tokenizer file of kind BPE with a word-end suffix."""

    def __init__(self, path: str, memo: int = MEMO):
        self.most = memo
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in chain(self.vocab.items(), self.special.items())}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.order = {pair: rank << ID_BITS | new for pair, (rank, new) in self.merge.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.odd_space = _re.compile("[\x1c-\x1f]").search
        self.space = regex.compile(r"\s+")
        self.cut_special = _re.compile("(" + "|".join(_re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.to_chars = {b: c for b, c in enumerate(alphabet)}
        self.inside = self._pairs_inside()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_words: dict[str, tuple[int, ...]] = {}

    def _pieces(self, token: str) -> list[str]:
        """The symbols that a token starts from: its characters, the last with the suffix if it has it."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _pairs_inside(self) -> set[tuple[str, str]]:
        found: set[tuple[str, str]] = set()
        for token in self.vocab:
            p = self._pieces(token)
            found.update(zip(p, p[1:]))
        return found

    # ------------------------------------------------------------ encoding

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """Cut a word's symbols at every neighbouring pair that no token holds."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in inside:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Apply the lowest rank, leftmost first, until none applies: quadratic, and faster than a heap for a few symbols."""
        get, none = self.order.get, NO_MERGE
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            at, new = found.index(best), best & ID_MASK
            ids[at : at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], new), none)
            if at < len(found):
                found[at] = get((new, ids[at + 1]), none)
        return ids

    def _merge_fragment(self, symbols: list[str]) -> list[int]:
        vocab, merge = self.vocab, self.merge
        ids = [vocab[s] for s in symbols if s in vocab]
        n = len(ids)
        if n < 2:
            return ids
        if n <= SHORT:
            return self._merge_short(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or merge.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge.get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if before[i] >= 0 and (m := merge.get((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], m[1]))
        return [x for x in ids if x >= 0]

    def word_ids(self, word: str) -> tuple[int, ...]:
        memo = self.memo_words
        got = memo.get(word)
        if got is None:
            symbols = [self.to_chars[b] for b in word.encode("utf-8")]
            symbols[-1] += self.suffix
            got = tuple(chain.from_iterable(map(self._merge_fragment, self.fragments(symbols))))
            if len(word) <= MEMO_CHARS:
                if len(memo) >= self.most:
                    memo.clear()
                memo[word] = got
        return got

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run without white space, remembered: no word of the file's pattern crosses white space."""
        memo = self.memo
        got = memo.get(chunk)
        if got is None:
            if not chunk.isascii() and FAR.search(chunk) and GAP.search(chunk):
                found = [chunk[m.start() : m.end()] for m in self.word.finditer(GAP.sub(STAND_IN, chunk))]
            else:
                found = self.word.findall(chunk)
            got = tuple(chain.from_iterable(map(self.word_ids, found)))
            if len(chunk) <= MEMO_CHARS:
                if len(memo) >= self.most:
                    memo.clear()
                memo[chunk] = got
        return got

    def normalise(self, text: str) -> str:
        if not text.isascii():
            high = HIGH.search(text)
            if high and MARK.search(text):
                text = "".join(unicodedata.normalize("NFC", p) for p in BARRIER.split(text))
            else:
                text = unicodedata.normalize("NFC", text)
            if high and CAPITAL.search(text):
                text = text.translate(SMALL)
        # White space becomes one space in the file; its words never hold any, so it may stay as it is.
        # Character by character: str.lower() alone would turn a final capital sigma into its final form.
        return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))

    def _plain(self, text: str) -> list[int]:
        text = self.normalise(text)
        # str.split() also splits at U+001C to U+001F, which the file's pattern takes for symbols.
        chunks = text.split() if not self.odd_space(text) else self.space.split(text)
        found = list(map(self.memo.get, chunks))
        if None in found:
            slow = self.chunk_ids
            found = [slow(c) if got is None else got for c, got in zip(chunks, found)]
        return list(chain.from_iterable(found))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut_special is None or "<|" not in text:
            return self._plain(text)
        out: list[int] = []
        for part in self.cut_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    # ------------------------------------------------------------ decoding

    def decode(self, ids) -> str:
        """Tokens in the file's own alphabet, joined by one space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def text_of(self, ids) -> str:
        """Readable text: bytes of the tokens, a space after each word's end."""
        back = {c: b for b, c in self.to_chars.items()}
        parts = []
        for t in map(self.token.__getitem__, ids):
            if t in self.special:
                parts.append(t.encode())
            else:
                end = bool(self.suffix) and t.endswith(self.suffix)
                parts.append(bytes(back[c] for c in (t[: -len(self.suffix)] if end else t)) + (b" " if end else b""))
        return b"".join(parts).decode("utf-8", "replace").rstrip(" ")


_LOADED: dict[tuple[str, int], Bpe] = {}


def loaded(path: str, memo: int = MEMO) -> Bpe:
    """One encoder for each worker process and file."""
    claim("bpe", _LOADED.clear)
    if (path, memo) not in _LOADED:
        _LOADED[path, memo] = Bpe(path, memo)
    return _LOADED[path, memo]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", ids: bool = False, memo: int = MEMO) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` the ids themselves as well. ``memo``: words that a worker remembers."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        bpe = loaded(path, memo)
        sha = hashlib.sha256
        for batch in batches:
            names = batch.column(0)
            column = batch.column(1)
            for at in range(0, len(batch), 256):
                rows = []
                for text in column.slice(at, 256).to_pylist():
                    got = bpe.encode(text)
                    rows.append((len(got), sha(np.array(got, "<u4").tobytes()).hexdigest(), sha(bpe.decode(got).encode("utf-8")).hexdigest(), got))
                n, a, b, got = zip(*rows)
                arrays = [names.slice(at, 256), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                fs = [pa.field("doc_id", names.type), *fields]
                if ids:
                    arrays.append(pa.array(got, pa.list_(pa.int32())))
                    fs.append(pa.field("ids", pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fs))

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
