"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model holds a whitespace marker after another symbol, nothing is merged across a marker that
follows a word, so a text's ids are those of its chunks (markers and the word behind them), one after the other.  Each
task keeps a table of the chunks it has met; a chunk that is new to it is segmented and decoded once, by the library, and
the ids come back to every place of the chunk by joining them in order.  Nothing is shuffled.  A long text is cut at chunk
borders and goes through in parts; a table that holds ``HELD`` characters is emptied.  A model whose
pieces cross markers, or that changes texts otherwise, has whole texts as chunks.

Defined results: a null or empty text has the begin and end ids and decodes to an empty text; a literal marker is a
space and decodes to one, as in the library; null ids and repeated rows are kept; an empty table gives no rows; other columns are
left out.  ``public_tokenizers`` holds the model; its path is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytetext import chunks as row_ranges
from .shared import table

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
#: A chunk begins at a space or marker that follows something else.
BORDER = re.compile(f"(?<![ {MARKER}])[ {MARKER}]")
PART = 1 << 20
HELD = 1 << 24
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_end_at_markers(coder) -> bool:
    """Whether no piece holds a marker behind another symbol, and a text is changed by marking its spaces alone."""
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    probe = "  Ａ ﬁ\t\n b́  c "
    apart = not any(crossing.search(coder.id_to_piece(i)) for i in range(coder.vocab_size()))
    return apart and coder.normalize(probe) == MARKER + probe.replace(" ", MARKER)


class ChunkTable:
    """The ids (little-endian, unsigned, 32 bits) and the decoded text of each distinct chunk."""

    def __init__(self, model: str, whole: bool | None = None):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.whole = not pieces_end_at_markers(self.coder) if whole is None else whole
        self.begin = np.array([self.coder.bos_id()], "<u4").tobytes()
        self.end = np.array([self.coder.eos_id()], "<u4").tobytes()
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.held = 0

    def chunks(self, text: str, first: bool) -> list[str]:
        """Chunks of a text's part; the library puts a marker before a text."""
        if self.whole:
            return [text] if text else []
        return CHUNK.findall((MARKER if first and text else "") + text.replace(" ", MARKER))

    def learn(self, chunks: Iterable[str]) -> None:
        """Segments the chunks that the table lacks."""
        new = [c for c in set(chunks) if c not in self.ids]
        if not new:
            return
        if self.whole:
            found = self.coder.encode(new, num_threads=1)
        else:
            # A chunk stands alone as the text of which it is the marked form; a lone marker as the end of one.
            found = self.coder.encode([c[1:].replace(MARKER, " ") for c in new], num_threads=1)
            lone = self.coder.encode("a ")[len(self.coder.encode("a")) :]
            found = [lone if c == MARKER else ids for c, ids in zip(new, found)]
        lead = "" if self.whole else " "
        for chunk, ids, text in zip(new, found, self.coder.decode(found)):
            self.ids[chunk] = np.array(ids, "<u4").tobytes()
            self.text[chunk] = lead + text
            self.held += len(chunk)

    def rest(self) -> None:
        """Empties a full table."""
        if self.held > HELD:
            self.ids, self.text, self.held = {}, {}, 0

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded text) of each text."""
        if sum(map(len, texts)) <= PART:
            cut = [[self.chunks(t, True)] for t in texts]
            self.learn(c for parts in cut for part in parts for c in part)
        else:
            cut = [(self.chunks(p, i == 0) for i, p in enumerate([t] if self.whole else parts_of(t))) for t in texts]
        for parts in cut:
            ids, decoded = [self.begin], []
            for part in parts:
                self.learn(part)
                ids.append(b"".join(map(self.ids.__getitem__, part)))
                decoded.append("".join(map(self.text.__getitem__, part)))
                self.rest()
            text = "".join(decoded)
            yield b"".join([*ids, self.end]), text if self.whole else text[1:]


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end at chunk borders."""
    start = 0
    while start < len(text):
        border = BORDER.search(text, start + size)
        end = border.start() if border else len(text)
        yield text[start:end]
        start = end


@cache
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids with begin and end as little-endian unsigned 32-bit bytes."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chunk_table(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for start, stop in row_ranges(texts, PART):
                ids, decoded = zip(*held.encode(texts.slice(start, stop - start).to_pylist()))
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                arrays = [batch.column(0).slice(start, stop - start), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of a table of ``ids``; null ids are none."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_table(path).coder
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coder.decode(ids), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
