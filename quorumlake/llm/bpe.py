"""Operator 10: byte-level BPE by prefix dynamic programming, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held, with_fields
from .pieces import PieceCache, pieces


class PrefixBPE:
    """Byte-pair encoding by the ranks of a vocabulary that holds every single byte.

    A sequence of tokens is what the merges give exactly if each two neighbours are what the merges give for their
    bytes alone. So each prefix of a text has one valid last token: the token ending there that is compatible with the
    last token of the prefix before it. Storing it for every prefix makes encoding linear in the text, appending exact,
    and after an edit only prefixes from the edit on change.
    """

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 1_000_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.most_pairs, self._pairs, self._alone = most_pairs, {}, {}

    @classmethod
    def load(cls, path: str) -> PrefixBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first and leftmost among equals; for short byte strings."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stands_alone(self, token: int) -> bool:
        if (got := self._alone.get(token)) is None:
            got = self._alone[token] = self.merged(self.bytes_of[token]) == [token]
        return got

    def compatible(self, left: int, right: int) -> bool:
        if (got := self._pairs.get((left, right))) is None:
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            got = self._pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def extend(self, data: bytes, last: list[int], since: int = 0) -> list[int]:
        """Stores the last tokens of all prefixes of data beyond `since`; last[i] is that of data[:i], last[0] unused."""
        ranks = self.ranks
        del last[since + 1 :]
        if not last:
            last.append(-1)
        for end in range(since + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (self.stands_alone(token) if start == 0 else self.compatible(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The tokens of the whole text, read back from the stored last tokens."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the word pattern; a match that is in the vocabulary is its own token.

        What is compatible from the start on is unique, so the longest token that goes on is tried first, and a place
        from which none goes on is not come to again. Few prefixes are looked at, where `extend` stores all of them.
        """
        ranks, pairs = self.ranks, self._pairs
        if (whole := ranks.get(data)) is not None:
            return [whole]
        size, longest = len(data), self.longest
        out, starts, dead = [], [], set()
        start, end = 0, min(size, longest)
        while start < size:
            while end > start:
                if (token := ranks.get(data[start:end])) is not None and end not in dead:
                    if not out:
                        good = self.stands_alone(token)
                    elif (good := pairs.get((out[-1], token))) is None:
                        good = self.compatible(out[-1], token)
                    if good:
                        break
                end -= 1
            if end > start:
                out.append(token)
                starts.append(start)
                start, end = end, min(size, end + longest)
            elif out:
                dead.add(start)
                out.pop()
                start, end = starts.pop(), start - 1
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableText:
    """A match of the word pattern with its stored prefixes, for exact appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, bpe.extend(data, [])

    def append(self, more: bytes) -> None:
        before, self.data = len(self.data), self.data + more
        self.bpe.extend(self.data, self.last, before)

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Only prefixes that reach beyond `start` are encoded again."""
        self.data = self.data[:start] + by + self.data[end:]
        self.bpe.extend(self.data, self.last, start)

    def tokens(self) -> list[int]:
        return self.bpe.tokens(self.last)


def encoder(path: str, pattern: str) -> tuple[PrefixBPE, PieceCache]:
    """The encoder of this Python worker and its cache of pieces, as little-endian 32-bit ids."""

    def load() -> tuple[PrefixBPE, PieceCache]:
        import regex

        bpe, matches = PrefixBPE.load(path), regex.compile(pattern)

        def make(some: list[str]) -> Iterator[bytes]:
            for piece in some:
                ids = [i for m in matches.findall(piece) for i in bpe.encode(m.encode())]
                yield b"".join(i.to_bytes(4, "little") for i in ids)

        return bpe, PieceCache(make)

    return held(("bpe", path, pattern), load)


def encode_texts(docs: DataFrame, *, path: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256, decoded_sha256 and, unless with_ids is false, ids array<int>.

    Each match of the pattern is encoded by itself, without special tokens; the ids are then decoded and the bytes
    digested. Null texts count as empty: no ids. Every row gives a row; other columns stay, unless they have one of the
    new names, when the new ones replace them. Texts of any length are cut into pieces that encode independently.
    """
    import pyarrow as pa

    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    others = [c for c in docs.columns if c != text_col and c.lower() not in new]
    base = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias(fresh(docs, "bpe_text")))
    schema = with_fields(docs.select(*others), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        bpe, cache = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 256):
                n = min(256, batch.num_rows - at)
                cut = [pieces(t) for t in texts.slice(at, n).to_pylist()]
                cache.fill(cut)
                encoded = [cache.joined(c) for c in cut]
                ids = [np.frombuffer(e, dtype="<i4") for e in encoded]
                columns = [batch.column(i).slice(at, n) for i in range(batch.num_columns - 1)]
                columns += [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                    pa.array([hashlib.sha256(bpe.decode(x.tolist())).hexdigest() for x in ids]),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype="int32"), np.concatenate(ids) if ids else np.zeros(0, "int32")))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return base.mapInArrow(run, schema)
