"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as a protobuf. The tokenizer is rebuilt from it: the normaliser (character map and space
collapsing), the metaspace mark in place of blanks, unigram scores as they are or byte-pair merges in the order of
their scores, and byte fallback. Texts are cut where no piece of the model can cross (before a mark that follows another
character), so that each different part is encoded once, in multithreaded batches. Every part is also encoded by the
sentencepiece library; where the two differ (ties between pieces of equal score) the library's ids are taken and the
part is counted.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Encoded, python_batches

MARK = "▁"
THREADS = 2
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Backend:
    """A SentencePiece model rebuilt for the tokenizers library."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            self.proto.ParseFromString(file.read())
        self.library = SentencePieceProcessor(model_file=path)
        self.pieces = [(p.piece, p.score, p.type) for p in self.proto.pieces]
        spec, rules = self.proto.trainer_spec, self.proto.normalizer_spec
        self.prefix, self.collapse = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        if spec.model_type == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], spec.unk_id, spec.byte_fallback)
        elif spec.model_type == BPE:
            model = models.BPE(
                {p: i for i, (p, _, _) in enumerate(self.pieces)}, self._merges(), unk_token=self.pieces[spec.unk_id][0],
                fuse_unk=True, byte_fallback=spec.byte_fallback,
            )
        else:
            raise ValueError("only unigram and byte-pair models can be rebuilt")
        self.tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(rules.precompiled_charsmap)] if rules.precompiled_charsmap else []
        if self.collapse:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        # Parts come with their mark in place, so the tokenizer neither adds nor splits.
        self.tokenizer.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", int(self.prefix), 0)]
        )
        self.whole = Tokenizer.from_str(self.tokenizer.to_str())
        self.whole.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "always" if self.prefix else "never", split=False)
        crossing = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))
        self.cut = None if crossing else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.octets = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode()
            for p, _, kind in self.pieces
        ]
        self.octets[spec.unk_id] = " ⁇ ".encode()
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.pieces])
        self.memo = Encoded(self._encode_parts)
        self.differing: set[str] = set()

    def _merges(self) -> list[tuple[str, str]]:
        """All ways to join two pieces to a third, best score first."""
        rank = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}
        found = []
        for p, score in rank.items():
            found += [(-score, len(p[:k]), p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        found.sort(key=lambda x: x[:2])
        return [(a, b) for _, _, a, b in found]

    def normalise(self, text: str) -> str:
        """A text as the model sees it, marks in place."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def parts(self, marked: str) -> list[str]:
        if not marked:
            return []
        if self.cut is None:
            return [marked]
        if MARK + MARK in marked or not marked.startswith(MARK) or marked.endswith(MARK):
            return self.cut.findall(marked)
        return [MARK + p for p in marked[1:].split(MARK)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        if self.cut is not None and self.prefix and self.normaliser is None:
            # The library adds the first mark itself.
            plain = [p[1:].replace(MARK, " ") if p.startswith(MARK) else None for p in parts]
            asked = [i for i, p in enumerate(plain) if p]
            for i, ids in zip(asked, self.library.encode([plain[i] for i in asked], num_threads=1)):
                if np.array(ids, "<u4").tobytes() != out[i]:
                    self.differing.add(parts[i])
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; none for null and empty ones."""
        parts = [self.parts(self.normalise(t or "")) for t in texts]
        if len(self.memo.known) > self.memo.limit:
            self.forget()
        return [np.frombuffer(b, "<u4") for b in self.memo.ids(parts)]

    def forget(self) -> None:
        """Empty the memo, and what is known of its parts: they are compared again when they come again."""
        self.memo.known.clear()
        self.differing.clear()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.octets.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_backends: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    """One backend for each model in a worker."""
    if path not in _backends:
        _backends[path] = Backend(path)
    return _backends[path]


SCHEMA = "n_tokens bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean, n_differing bigint"


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_tokens, n_byte_pieces, ids_crc32, round_trip, n_differing[, ids]).

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``round_trip`` tells whether decoding gives
    the normalised text again; ``n_differing`` counts parts in which the rebuilt tokenizer and the library differed.

    * Null and empty texts have no ids, and decode to the empty text. Null ids and repeated rows pass through; an empty
      table gives no rows. Other columns are not read.
    * Texts of any length are encoded whole; a batch of documents must fit into a task. The ids are those of the rebuilt
      tokenizer, also where the library differs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(path)
        for batch in python_batches(batches):
            texts = batch.column(1).to_pylist()
            ids = model.encode(texts)
            seen = [model.normalise(t or "") for t in texts]
            skip = int(model.prefix)
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(model.is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array([model.decode(x) == s.replace(MARK, " ")[skip:] for x, s in zip(ids, seen)], pa.bool_()),
                pa.array([sum(p in model.differing for p in model.parts(s)) if model.differing else 0 for s in seen], pa.int64()),
            ]
            names = [id_col, *(f.split()[0] for f in SCHEMA.split(", "))]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        model.forget()  # the worker is used again by other stages

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def whole_text_ids(model: Backend, text: str) -> list[int]:
    """Ids of a text by the rebuilt tokenizer in one piece, for comparison."""
    return model.whole.encode(text, add_special_tokens=False).ids if text else []


def settings(model: Backend) -> str:
    """What was read from the model file, as JSON."""
    kinds = [k for _, _, k in model.pieces]
    return json.dumps(
        {
            "type": model.proto.trainer_spec.model_type,
            "pieces": len(kinds),
            "bytes": kinds.count(BYTE),
            "prefix": model.prefix,
            "collapse": model.collapse,
        }
    )
