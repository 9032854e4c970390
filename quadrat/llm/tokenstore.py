"""Token-id files: blocks of ids, transposed into byte planes, each plane compressed on its own.

Layout of a file: the planes of block 0, of block 1 and so on, then a zstandard-compressed
JSON index, its length (8 bytes, little-endian) and the magic. The index has, for every
block, its offset and the size of each plane, and the length of every document.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedFiles, materialize, new_folder, small_batches
from .units import UnitCache, in_blocks, is_bare, is_plain

MAGIC = b"BPLANES1"
BLOCK = 1 << 16
OUT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def pack_block(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """Four compressed byte planes, least significant first, of up to BLOCK uint32 ids."""
    planes = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(p.tobytes()) for p in planes]


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    inflate = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(inflate.decompress(p, max_output_size=max(n, 1)), np.uint8) for p in planes]
    if any(len(r) != n for r in rows):
        raise ValueError("a plane has a wrong length")
    return np.ascontiguousarray(np.stack(rows).T).reshape(-1).view("<u4")


def file_chunks(documents: Iterable[tuple[int | None, np.ndarray]], summary: dict) -> Iterator[bytes]:
    """The file's bytes. ``summary`` gets the count of ids. Holds one block and the index only."""
    index: dict = {"block": BLOCK, "blocks": [], "doc_ids": [], "lengths": []}
    offset, held, waiting = 0, 0, []

    def flush(ids: np.ndarray) -> Iterator[bytes]:
        nonlocal offset
        planes = pack_block(ids)
        index["blocks"].append([offset, len(ids), *map(len, planes)])
        offset += sum(map(len, planes))
        yield from planes

    total = 0
    for doc_id, ids in documents:
        index["doc_ids"].append(doc_id)
        index["lengths"].append(len(ids))
        total += len(ids)
        waiting.append(ids)
        held += len(ids)
        if held >= BLOCK:
            all_ids = np.concatenate(waiting)
            full = held // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                yield from flush(all_ids[i : i + BLOCK])
            waiting, held = [all_ids[full:]], held - full
    if held:
        yield from flush(np.concatenate(waiting))
    summary["n_ids"] = total
    packed = zstandard.ZstdCompressor(level=3).compress(json.dumps(index).encode())
    yield packed + len(packed).to_bytes(8, "little") + MAGIC


def read_index(source) -> dict:
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token-id file")
    n = int.from_bytes(tail[:8], "little")
    source.seek(end - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_blocks(source, index: dict) -> Iterator[np.ndarray]:
    for offset, n, *sizes in index["blocks"]:
        source.seek(offset)
        yield unpack_block([source.read(s) for s in sizes], n)


def read_documents(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in file order; inflates a block at a time."""
    index = read_index(source)
    blocks, rest = read_blocks(source, index), np.zeros(0, "<u4")
    for doc_id, n in zip(index["doc_ids"], index["lengths"], strict=True):
        parts, need = [], n
        while need:
            if not len(rest):
                rest = next(blocks)
            parts.append(rest[:need])
            rest = rest[len(parts[-1]) :]
            need -= len(parts[-1])
        yield doc_id, np.concatenate(parts) if parts else np.zeros(0, "<u4")


def read_range(source, first: int, count: int) -> np.ndarray:
    """ids [first, first + count) of the file: only the blocks that hold them are read."""
    index = read_index(source)
    block = index["block"]
    keep = dict(index, blocks=index["blocks"][first // block : (first + count - 1) // block + 1 if count else first // block])
    found = list(read_blocks(source, keep))
    return np.concatenate(found)[first % block : first % block + count] if found else np.zeros(0, "<u4")


class TokenIds:
    """Ids of whole texts as little-endian uint32 bytes, as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # tokens that begin with a space
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.units = UnitCache(self._fill, bytes.__add__, 400_000)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, units: list[str]) -> list[bytes]:
        """Many units go through the library in one text where the ids show the bounds again: each
        space of a run of plain units begins one, and bare ones are set apart by line feeds."""
        known: dict[str, bytes] = {}
        feed = np.array([self.feed], "<u4").tobytes()
        fed = [u for u in units if u[0] == "\n" and is_bare(u[1:])]
        plain, bare = [u for u in units if is_plain(u)], list(dict.fromkeys([*(u for u in units if is_bare(u)), *(u[1:] for u in fed)]))
        runs = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for run, ids in zip(runs, self._encode(["".join(r) for r in runs]), strict=True):
            raw, cuts = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * 4).tolist()
            known.update(zip(run, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)])), strict=True))
        runs = [bare[i : i + 1000] for i in range(0, len(bare), 1000)]
        for run, ids in zip(runs, self._encode(["\n".join(r) for r in runs]), strict=True):
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.feed) * 4).tolist()
            known.update(zip(run, map(raw.__getitem__, map(slice, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)])), strict=True))
        known.update((u, feed + known[u[1:]]) for u in fed)
        others = [u for u in units if u not in known]
        known.update((u, ids.tobytes()) for u, ids in zip(others, self._encode(others), strict=True))
        return [known[u] for u in units]

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """For each text parts that concatenate to its ids. A text that holds the string of a special token goes
        through the library as a whole."""
        whole = [any(s in t for s in self.specials) for t in texts]
        found = iter(self.units.lookup([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [[self._encode([t])[0].tobytes()] if w else next(found) for t, w in zip(texts, whole, strict=True)]


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    """One for each worker process."""
    return TokenIds(path)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, parts: int) -> DataFrame:
    """Encodes the documents in ascending doc_id order into up to ``parts`` files; returns (part, name, n_ids).

    Rows are ranged by doc_id (nulls first; ties by text), so file order is id order.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches):
        part = TaskContext.get().partitionId()
        encode = token_ids(path).encode

        def documents():
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for start, block in in_blocks(texts):
                    for k, found in enumerate(encode(block)):
                        found.append(tail)
                        yield ids[start + k], np.frombuffer(b"".join(found), "<u4")

        found = documents()
        first = next(found, None)
        if first is None:
            return
        name, summary = f"part-{part:06d}.ids", {}
        SharedFiles(folder).write(name, file_chunks((x for some in ([first], found) for x in some), summary))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_ids": pa.array([summary["n_ids"]], pa.int64())})

    ranged = small_batches(docs).select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialize(ranged.mapInArrow(write, "part int, name string, n_ids bigint"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = files.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("first"))

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows = []
                with SharedFiles(folder).open(name) as source:
                    for doc_id, ids in read_documents(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                        start += len(ids)
                columns = list(zip(*rows, strict=True))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, files.count()), "name").mapInArrow(read, OUT)


def token_round_trip(docs: DataFrame, path: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Encodes, writes and reads back every document.

    A null or empty text is the end id alone. Repeated rows are written as often as they
    occur. No documents: no files and no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_token_files(write_token_files(docs, folder, path, end_id, parts), folder)
