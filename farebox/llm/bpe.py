"""BPE encoding by forced boundaries, and decoding.

A merge can only make a token of the vocabulary. If two neighbouring symbols never stand
side by side inside any token, no merge ever spans them: the text can be cut there, the
fragments encoded on their own and the ids concatenated, with the same result as encoding
the whole. Fragments are short and repeat, so each task remembers their ids.

The vocabulary file is a BPE with word ends (``end_of_word_suffix``), a byte alphabet, a
normaliser of NFC, white space to one space and lower case, and a splitting pattern.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from farebox.llm.tables import text_last

MEMO_WORDS, MEMO_FRAGMENTS = 1 << 18, 1 << 16  # remembered by a process: some 80 MB
TYPES = "n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ForcedBoundaryBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        steps = {s["type"]: s for s in spec["pre_tokenizer"]["pretokenizers"]}
        self.words = regex.compile(steps["Split"]["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.letters = dict(enumerate(byte_letters()))
        # neighbours inside tokens; the last symbol of a word is another symbol than inside
        split = map(self.symbols_of, self.vocab)
        self.joined = {pair for symbols in split for pair in zip(symbols, symbols[1:])}
        self.memo: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self.fragments: dict[tuple[str, ...], bytes] = {}

    def symbols_of(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            inner = token[: -len(self.end)]
            return [*inner[:-1], inner[-1] + self.end]
        return list(token)

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()  # white space is no part of a word, so one space or many
        text = unicodedata.normalize("NFC", text)
        # letter by letter: the lower case of a sigma must not depend on where it stands
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def cut(self, symbols: list[str]) -> Iterator[tuple[str, ...]]:
        """The fragments between forced boundaries."""
        start = 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.joined:
                yield tuple(symbols[start:i])
                start = i
        yield tuple(symbols[start:])

    def merge(self, fragment: tuple[str, ...]) -> bytes:
        """The ids of one fragment: merge the pair of the lowest rank, leftmost first."""
        known = self.fragments.get(fragment)
        if known is not None:
            return known
        parts, rank_of, never = list(fragment), self.ranks.get, 1 << 60
        if len(parts) > 256:
            parts = self.merge_long(parts)
        else:
            ranks = [rank_of(pair, never) for pair in zip(parts, parts[1:])]
            while ranks and (lowest := min(ranks)) != never:
                i = ranks.index(lowest)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank_of((parts[i - 1], parts[i]), never)
                if i < len(ranks):
                    ranks[i] = rank_of((parts[i], parts[i + 1]), never)
        ids = pack([self.vocab[p] for p in parts])
        if len(self.fragments) >= MEMO_FRAGMENTS:
            self.fragments.clear()
        if len(fragment) <= 64:
            self.fragments[fragment] = ids
        return ids

    def merge_long(self, parts: list[str]) -> list[str]:
        """The same for long fragments, by a heap over a linked list."""
        import heapq

        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        text: list[str | None] = list(parts)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if text[i] != a or j < 0 or text[j] != b:
                continue
            text[i], text[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    pair = (text[left], text[right])
                    if (r := self.ranks.get(pair)) is not None:
                        heapq.heappush(heap, (r, left, *pair))
        return [t for t in text if t is not None]

    def word(self, word: str) -> bytes:
        known = self.memo.get(word)
        if known is not None:
            return known
        letters = self.letters
        symbols = [letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        ids = b"".join([self.merge(fragment) for fragment in self.cut(symbols)])
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) <= 64:
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        ids: list[bytes] = []
        start = 0
        for m in self.specials.finditer(text) if "<|" in text else ():
            self._encode_plain(text[start : m.start()], ids)
            ids.append(pack([self.special[m.group()]]))
            start = m.end()
        self._encode_plain(text[start:] if start else text, ids)
        return b"".join(ids)

    def _encode_plain(self, text: str, ids: list[bytes]) -> None:
        memo, word = self.memo, self.word
        ids += [memo.get(w) or word(w) for w in self.words.findall(self.normalise(text))]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
    results: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all) and token columns for every row.

    ``ids`` holds the ids as little-endian unsigned 32-bit integers, ``decoded`` the text
    they decode to; ``results`` names those of ``TYPES`` to make. A null or empty text has
    no ids and decodes to the empty text. Columns of ``docs`` with the name of a result
    give way to it. The vocabulary file is read on every executor from ``path``.
    """
    kinds = dict(part.split(" ") for part in TYPES.split(", "))
    results = list(kinds) if results is None else results
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    source, at = text_last(docs, text, keep)
    schema = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
        + [f"{r} {kinds[r]}" for r in results]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        for batch in batches:
            made: dict[str, list] = {r: [] for r in results}
            for value in batch.column(at):
                packed = bpe.encode_packed(value.as_py() or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                decoded = bpe.decode(ids)
                row = {
                    "n_tokens": len(ids),
                    "ids": packed,
                    "ids_sha256": hashlib.sha256(packed).hexdigest(),
                    "decoded": decoded,
                    "decoded_sha256": hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                }
                for r in results:
                    made[r].append(row[r])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(made[r], arrow[kinds[r]]) for r in results)],
                names=[*keep, *results],
            )

    return source.mapInArrow(run, schema)
