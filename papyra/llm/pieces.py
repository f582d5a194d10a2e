"""SentencePiece encoding by a table of distinct chunks.

In the model's vocabulary no piece holds a white-space marker after another
character (checked when a model is loaded), so no merge can cross such a place.
A marked text thus falls into chunks, each a run of markers and the characters up
to the next marker, that are segmented independently. Every distinct chunk of a
batch is segmented once; ids, counts and decoded bytes are then joined back by
position. The table is emptied after texts that leave more than `TABLE_CHUNKS`
chunks in it, and when a task ends: Spark deals tasks to all its idle workers in
turn, and each would keep a table beside those that run.

Defined cases: null text is empty and gives the end id alone; U+2581 in a text is
a marker like a space, as in the library; repeated rows stay; other columns of
the input are ignored. A model whose pieces cross markers is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.flat import release
from papyra.plans.durable import one_worker_pool, small_batches

MARK = "▁"
TABLE_CHUNKS = 50_000
#: Chunks longer than this are segmented but not kept in the table.
KEPT_CHARS = 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_chunk = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkEncoder:
    """Encodes with an end id, chunk by chunk, exactly as the library does whole texts."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())):
            raise ValueError("a piece of this model crosses a white-space marker")
        self.mark = self.sp.piece_to_id(MARK)
        self.end = b"%d" % self.sp.eos_id()
        self.table: dict[str, tuple[bytes, int, bytes]] = {}

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def learn(self, chunks: set[str]) -> None:
        """Segments what the table lacks; an entry holds the ids as text, their number, and the decoded bytes with the leading space."""
        new = [c for c in chunks if c not in self.table]
        # The library puts one marker before what it encodes: the chunk's first is left to it.
        ids = [i or [self.mark] for i in self.sp.encode([c[1:] for c in new], num_threads=1)]
        text = self.sp.decode(ids, num_threads=1) if ids else []
        for c, i, t in zip(new, ids, text):
            self.table[c] = (" ".join(map(str, i)).encode(), len(i), b" " + t.encode())

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, int, bytes]]:
        """Ids as decimal text, their number and the decoded bytes of each text."""
        split = [_chunk.findall(self.marked(t or "")) for t in texts]
        self.learn(set().union(*split))
        for cs in split:
            if cs:
                ids, n, text = zip(*map(self.table.__getitem__, cs))
                yield b" ".join(ids) + b" " + self.end, sum(n) + 1, b"".join(text)[1:]
            else:
                yield self.end, 1, b""
        if len(self.table) > TABLE_CHUNKS:
            self.table.clear()
        else:
            for c in {c for cs in split for c in cs if len(c) > KEPT_CHARS}:
                self.table.pop(c, None)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(model: str) -> ChunkEncoder:
    if model not in _encoders:
        _encoders[model] = ChunkEncoder(model)
    return _encoders[model]


#: Characters of the texts that are encoded together.
TOGETHER = 1 << 18


def _in_turn(e: ChunkEncoder, texts: list[str | None]) -> Iterator[tuple[bytes, int, bytes]]:
    """What `encode` gives for each text, some texts at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < TOGETHER):
            size += len(texts[to] or "")
            to += 1
        yield from e.encode(texts[at:to])
        at = to


def _with_encoder(model: str, f: Callable[[ChunkEncoder, pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for each batch; what the task learned goes when it ends."""

    def run(batches):
        e = encoder(model)
        try:
            for b in batches:
                if b.num_rows:
                    yield f(e, b)
                release()
        finally:
            e.table.clear()
            release()

    return run


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of its decoded text."""
    one_worker_pool(docs.sparkSession)
    small_batches(docs.sparkSession)

    def digests(e, b):
        n, i, t = zip(*((n, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()) for i, n, t in _in_turn(e, b.column(1).to_pylist())))
        return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(t)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_with_encoder(model, digests), RESULT)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id and its ids as array<int>, for training."""
    small_batches(docs.sparkSession)

    def encoded(e, b):
        ids = [[int(x) for x in i.split()] for i, _, _ in _in_turn(e, b.column(1).to_pylist())]
        return pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_with_encoder(model, encoded), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """Per row of doc_id, ids: doc_id and text, by the library's decode."""

    def run(batches):
        e = encoder(model)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(e.sp.decode([x or [] for x in b.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
