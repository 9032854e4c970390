"""SentencePiece BPE by a table of prefixes: each prefix of a text has one last token, and ids are read off backwards.

An automaton finds the pieces that end at a place. The last token of a prefix is the one piece that may follow
the last token of what is before it: undoing the two tokens' merges, latest first, must never show a merge across
their border that would have come earlier. So no merge is carried out on texts, and work is linear in
their length, whatever the words look like.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .units import ENDS, VERBATIM, UnitCache, in_blocks, unit_of

OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6  # types of pieces in the public sentencepiece_model.proto


class PieceBpe:
    """Encodes and decodes as the sentencepiece library does with a BPE model of identity normalisation and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback, identity normalisation and escaped spaces is needed")
        if odd := {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of types {sorted(odd)} are not built")
        self.prefixed = spec.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.unknown = trained.unk_surface
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        normal = sorted((-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL)
        #: Merges come by score, the leftmost first among equals; of a token the rank, equal for equal scores.
        self.rank: dict[int, float] = {i: rank for rank, i in normal}
        self.ids = {self.texts[i]: i for _, i in normal}
        if lone := {c for text in self.ids for c in text} - self.ids.keys():
            raise ValueError(f"characters of pieces are no pieces: {sorted(lone)[:5]}")
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._compatible = lru_cache(1 << 18)(self.compatible)
        self._split(i for _, i in normal)
        self.automaton = ahocorasick.Automaton()
        for i in self.halves:
            self.automaton.add_word(self.texts[i], (i, len(self.texts[i])))
        self.automaton.make_automaton()
        self.inner = {text[k : k + 2] for text in self.ids for k in range(len(text) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.inner):
            raise ValueError("a piece goes on after a space that follows a word")
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.apart = next(c for c in map(chr, range(1, 0x10FFFF)) if c not in self.ids)  # a character that no piece holds
        self.names = [str(i) for i in range(len(self.texts))]
        self.shown = [t.replace(SPACE, " ") for t in self.texts]
        self.cache = Pieces(self, 200_000)

    def _split(self, ordered) -> None:
        """The two tokens that each piece is merged from at last; single characters have none, and pieces that no merges reach are left out.

        Shorter pieces first, so that a piece's halves are known.
        """
        for i in sorted(ordered, key=lambda i: (len(self.texts[i]), self.rank[i])):
            text = self.texts[i]
            if len(text) == 1:
                self.halves[i] = None
                continue
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left in self.halves and right in self.halves and self.compatible(left, right, self.rank[i]):
                    if max(self.made(left), self.made(right)) > self.rank[i]:
                        raise ValueError(f"piece {text!r} scores above one that it is made of")
                    self.halves[i] = left, right
                    break

    def made(self, token: int) -> float:
        """The rank of the merge that made a token; characters are there from the start."""
        return self.rank[token] if self.halves[token] else -1

    def compatible(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours, or, up to ``limit``, as the halves that merge then.

        The later of the two tokens' last merges is undone, of equal ones the right one, since the left came first.
        A merge of what then meets at the border must not have come before it.
        """
        strict = True  # a merge of the limit's own rank comes later
        while True:
            both = self.ids.get(self.texts[left] + self.texts[right])
            if both is not None and (self.rank[both] < limit or not strict and self.rank[both] == limit):
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and self.rank[left] > self.rank[right]:
                limit, strict, left = self.rank[left], True, a[1]
            else:
                limit, strict, right = self.rank[right], False, b[0]

    def tokens(self, units: list[str]) -> list[list[int | str]]:
        """The tokens of texts whose spaces are escaped: ids, and characters that no piece holds as themselves.

        One table serves many texts, with a character between them that no token crosses.
        """
        text = self.apart.join(units)
        last: list = list(text)  # by the place where a prefix ends
        length = [1] * len(text)
        fits, done = self._compatible, -1
        for end, (token, size) in self.automaton.iter(text):
            if end == done:
                continue  # the prefix has its token
            before = end - size
            if before < 0 or (prior := last[before]).__class__ is str or fits(prior, token):
                last[end], length[end], done = token, size, end
        found, begin = [], 0
        for unit in units:
            k, out = begin + len(unit) - 1, []
            while k >= begin:
                out.append(last[k])
                k -= length[k]
            out.reverse()
            found.append(out)
            begin += len(unit) + 1
        return found

    def values_of(self, units: list[str]) -> list[tuple[str, int, str]]:
        """Of each unit, its spaces escaped, the ids in decimal, their number, and what they decode to."""
        out = []
        for tokens in self.tokens(units):
            try:
                out.append((",".join(map(self.names.__getitem__, tokens)), len(tokens), "".join(map(self.shown.__getitem__, tokens))))
            except TypeError:  # characters without a piece
                ids = [i for t in tokens for i in ([t] if isinstance(t, int) else [self.bytes[b] for b in t.encode("utf-8", "surrogatepass")])]
                out.append((",".join(map(str, ids)), len(ids), self._decoded(ids)))
        return out

    def _decoded(self, ids) -> str:
        """Pieces' texts joined, spaces unescaped; runs of byte pieces read as UTF-8, each byte that isn't as U+FFFD."""
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.values:
                held.append(self.values[i])
                continue
            if held:
                out.append(utf8(bytes(held)))
                held.clear()
            if i is not None and self.kinds[i] != CONTROL:
                out.append(self.unknown if self.kinds[i] == UNKNOWN else self.texts[i].replace(SPACE, " "))
        return "".join(out)

    def keys(self, text: str) -> list[str]:
        """A key for each unit, a word and the spaces before it: ``w`` for a space and w, a line feed and w for these, VERBATIM and u for u.

        No piece goes on after a space that follows a word; a line feed, where no piece holds it, begins a unit.
        """
        if not text:
            return []
        if self.prefixed and SPACE not in text and "\n" not in self.ids:
            words = text.replace("\n", " \n").split(" ")
            if "" not in words:
                return words
        units = self.runs((SPACE if self.prefixed else "") + text.replace(" ", SPACE))
        return [u[1:] if u[0] == SPACE and u[1:2] not in ("", SPACE, "\n") and "\n" not in u else VERBATIM + u for u in units]

    def lookup(self, texts: list[str]) -> list[list[tuple[str, int, str]]]:
        """For each text its units' values."""
        return self.cache.lookup(texts)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.lookup([text])[0] for i in ids.split(",")]

    def decode(self, ids) -> str:
        """The text; the space that encoding put before it goes."""
        text = self._decoded(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.prefixed and first is not None and self.texts[first].startswith(SPACE) else text


def utf8(raw: bytes) -> str:
    """``raw`` as UTF-8; each byte that begins no whole character becomes U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + size].decode())
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


class Pieces(UnitCache):
    """Values of units by their keys. What ends a word is looked up by itself where no piece holds its first character after the word's last."""

    def __init__(self, bpe: PieceBpe, most: int):
        super().__init__(bpe.values_of, lambda a, b: (f"{a[0]},{b[0]}", a[1] + b[1], a[2] + b[2]), most)
        self.bpe = bpe

    def _learn(self, keys: list[str]) -> None:
        parts: dict[str, tuple[str, str]] = {}
        wanted: dict[str, None] = {}
        for k in keys:
            base = k.rstrip(ENDS)
            if base and len(base) < len(k) and not k.startswith(VERBATIM) and base != "\n" and k[len(base) - 1 : len(base) + 1] not in self.bpe.inner:
                parts[k] = base, VERBATIM + k[len(base) :]
                wanted.update(dict.fromkeys(parts[k]))
            else:
                wanted[k] = None
        fresh = list(self._promoted(wanted.keys() - self.new.keys()))
        for start in range(0, len(fresh), 2_000):
            some = fresh[start : start + 2_000]
            self.new.update(zip(some, self.fill([unit_of(k).replace(" ", SPACE) for k in some]), strict=True))
        for k, (base, end) in parts.items():
            self.new[k] = self.join(self.new[base], self.new[end])

    def lookup(self, texts: list[str]) -> list[list[tuple]]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        cut = [self.bpe.keys(t) for t in texts]
        self._learn(list(self._promoted(set().union(*cut).difference(self.new))))
        get = self.new.__getitem__
        return [list(map(get, keys)) for keys in cut]


@lru_cache(2)
def piece_bpe(path: str) -> PieceBpe:
    """One for each worker process."""
    return PieceBpe(path)


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text of every document.

    A null text is empty: no tokens, and the digests of nothing. Repeated rows give repeated results, an
    empty table none; other columns are ignored. Long texts without spaces cost no more a character than others.
    ``path`` must exist on every executor. No shuffle.
    """

    def encode(batches):
        bpe = piece_bpe(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            counts, shas, decoded = [], [], []
            for _, block in in_blocks(texts):
                for units in bpe.lookup(block):
                    strings, lengths, back = zip(*units, strict=True) if units else ((), (), ())
                    text = "".join(back)
                    counts.append(sum(lengths))
                    shas.append(hashlib.sha256(",".join(strings).encode()).hexdigest())
                    decoded.append(hashlib.sha256(text[1 if bpe.prefixed else 0 :].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(encode, OUT)
