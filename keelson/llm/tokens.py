"""Token counts of whole documents: overlapping chunks spliced at proven common boundaries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import cached, only

#: Letters, digits and white space of the texts that the piece path reads: ASCII and Latin letters up to U+024F,
#: whose character classes are the same in every Unicode version. Other texts go to the library as a whole.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
OUTSIDE = f"[^\\t\\n -~{LATIN}]"
#: The byte-level pre-tokenizer's pattern (a fixed value of that tokenizer), over those characters.
PIECE = f"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^ \\t\\n{LATIN}0-9]+|[ \\t\\n]+(?![^ \\t\\n])|[ \\t\\n]+"
#: A boundary this near a chunk's cut end may depend on characters beyond it; added tokens may widen it.
MARGIN = 16


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """Ids of pre-tokenizer pieces as little-endian uint32 bytes; holds at most ``bound`` of them."""

    def __init__(self, model, bound: int = 400_000):
        self.model, self.bound, self.letters = model, bound, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ids = np.array([x.id for x in found], dtype="<u4").tobytes()
        if len(self) < self.bound:
            self[piece] = ids
        return ids


class Encoder:
    """A public tokenizer; without begin, end or padding tokens and without truncation.

    ``splits`` tells whether it is byte-level BPE over the usual pattern: then no token crosses a piece,
    a piece depends only on what follows its start, and chunks can be spliced.
    """

    def __init__(self, definition: str | bytes):
        self.library = None
        self.splits = False
        if isinstance(definition, bytes):
            import sentencepiece

            self.sentences = sentencepiece.SentencePieceProcessor(model_proto=definition)
            return
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        first, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.splits = (
            spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        self.margin = max([MARGIN, *(2 * len(x) for x in self.added)])
        self.pieces = Pieces(self.library.model)
        self.outside, self.piece = re.compile(OUTSIDE), re.compile(PIECE)

    def plain(self, text: str) -> bool:
        """Whether the piece path reads this text."""
        return self.splits and not self.outside.search(text) and not any(x in text for x in self.added)

    def ids(self, text: str) -> bytes:
        """The ids of the whole text as little-endian uint32 bytes."""
        if self.library is None:
            return np.array(self.sentences.encode(text, num_threads=1), dtype="<u4").tobytes()
        if self.plain(text):
            return b"".join(map(self.pieces.__getitem__, self.piece.findall(text)))
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4

    def marks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a chunk start, and the tokens in each."""
        if self.plain(text):
            found = self.piece.findall(text)
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            tokens = np.fromiter((len(self.pieces[x]) // 4 for x in found), dtype=np.int64, count=len(found))
            return np.cumsum(lengths) - lengths, tokens
        encoding = self.library.encode(text, add_special_tokens=False)
        words = np.array([-1 if x is None else x for x in encoding.word_ids], dtype=np.int64)
        begins = np.array([x[0] for x in encoding.offsets], dtype=np.int64)
        fresh = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)]) if len(words) else np.zeros(0, np.int64)
        return begins[fresh], np.diff(np.r_[fresh, len(words)])

    def count_spliced(self, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
        """Tokens, chunks and widenings of a long text.

        The left chunk starts at a true boundary, so each of its boundaries is true that is more than a margin before its
        cut end. The right chunk starts ``overlap`` before that end; a boundary of both is true for both from there on,
        since a piece depends only on what follows its start. Without one, the overlap doubles; at the size of the
        chunk, the chunk grows instead.
        """
        n, total, chunks, widened = len(text), 0, 1, 0
        at, size = 0, chunk
        starts, tokens = self.marks(text[: min(n, size)])
        end = min(n, size)
        while end < n:
            back, splice = overlap, -1
            while splice < 0:
                begin = max(at, end - back)
                if begin <= at:  # nothing of this chunk is left to align with
                    size *= 2
                    end = min(n, at + size)
                    starts, tokens = self.marks(text[at:end])
                    starts = starts + at
                    widened += 1
                    break
                stop = min(n, begin + chunk)
                right, right_tokens = self.marks(text[begin:stop])
                right = right + begin
                proven = starts[(starts > begin) & (starts <= end - self.margin)]
                common = np.intersect1d(proven, right)
                if len(common):
                    splice = int(common[0])
                else:
                    back *= 2
                    widened += 1
            if splice >= 0:
                total += int(tokens[starts < splice].sum())
                kept = right >= splice
                starts, tokens, at, end, size = right[kept], right_tokens[kept], splice, stop, chunk
                chunks += 1
        return total + int(tokens.sum()), chunks, widened


def read_definition(path: str) -> str | bytes:
    """The tokenizer file's content, read by the driver and shipped by broadcast; a vocabulary does not grow with the data."""
    with open(path, "rb") as f:
        content = f.read()
    return content if path.endswith(".model") else content.decode()


def encoder(shipped) -> Encoder:
    return cached("encoder", hash(shipped.value), lambda: Encoder(shipped.value))


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """Bytes and tokens of every whole text: (id, n_bytes, n_tokens, over_limit, n_chunks, n_widened).

    Texts over ``chunk`` characters are encoded in overlapping chunks and spliced; shorter ones at once. Tokenizers whose
    pieces are not independent (lower-casing, sentencepiece) encode every text at once. One narrow pass: no shuffle, memory
    of one chunk beyond the text itself. Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_definition(tokenizer_path))
    source = only(docs, id=id_col, text=text_col)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(shipped)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                if len(text) > chunk and encode.splits:
                    rows.append((len(text.encode()), *encode.count_spliced(text, chunk, overlap)))
                else:
                    rows.append((len(text.encode()), encode.count(text), 1, 0))
            n_bytes, n_tokens, chunks, widened = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [], [])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(chunks), pa.array(widened)], names=["id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long").withColumnRenamed("id", id_col)
