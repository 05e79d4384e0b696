"""Unigram token counts by trie-shared dynamic programming.

Per stretch of texts the distinct pre-tokens (words) are sorted and inserted into a trie; walking
it in order, the best score of each prefix is computed once, from its own prefixes, and
shared by all pre-tokens that begin with it. What remains per pre-token is the token count at
its terminal, which all its occurrences look up. Nothing is shuffled; a worker remembers
terminals between stretches, within a bound.

Vocabulary: the pieces of a public SentencePiece model. A piece's unigram score is
-log(rank + 2), Zipf's law over the model's order. A character no piece covers falls back to
its bytes, one token each, at the score of the rarest piece. Among segmentations with
equal scores the one with fewer tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetgrid.llm import rolling
from sheetgrid.llm.common import plain

MARK = "▁"
_REMEMBERED = 500_000


class Unigram:
    """Pieces with scores, as a trie over reversed pieces: the pieces that end at a place are
    found walking backwards, as long as some piece has that ending."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.rarest = min(scores.values(), default=0.0)
        self.endings: dict = {}
        for piece, score in scores.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    @staticmethod
    def of_model(path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        return Unigram({piece: -math.log(rank + 2) for rank, piece in enumerate(ranked)})

    def step(self, text: str, end: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """(score, -tokens) of text[:end], from `best`, the same of each shorter prefix."""
        node, at = self.endings, end
        found = None
        while at:
            at -= 1
            node = node.get(text[at])
            if node is None:
                break
            score = node.get("")
            if score is not None:
                before = best[at]
                here = (before[0] + score, before[1] - 1)
                if found is None or here > found:
                    found = here
        if text[end - 1] not in self.scores:
            size = len(text[end - 1].encode("utf-8", "replace"))
            here = (best[end - 1][0] + size * self.rarest, best[end - 1][1] - size)
            found = here if found is None else max(found, here)
        return found

    def terminals(self, words: list[str]) -> dict[str, int]:
        """Token count of each word, MARK in front; a prefix shared by words is computed once."""
        out: dict[str, int] = {}
        path, best = "", [(0.0, 0)]  # the way from the root to the present node, and its scores
        for word in sorted(words):
            text = MARK + word
            shared = 0
            for a, b in zip(path, text):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                best.append(self.step(text, end, best))
            path = text
            out[word] = -best[-1][1]
        return out


_models: dict[str, Unigram] = {}
_known: dict[str, dict[int, int]] = {}


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _models:
        _models[path], _known[path] = Unigram.of_model(path), {}
    model, known = _models[path], _known[path]
    for batch in batches:
        for c in rolling.chunks(batch.column("text"), chunk_bytes=4 * rolling.CHUNK_BYTES):
            distinct, first, which = np.unique(c.words, return_index=True, return_inverse=True)
            keys = distinct.tolist()
            new = [i for i, k in enumerate(keys) if k not in known]
            if len(known) + len(new) > _REMEMBERED:
                known.clear()
                new = range(len(keys))
            text = {}
            for i in new:
                at = first[i]
                text[keys[i]] = c.data[c.starts[at] : c.ends[at]].tobytes().decode("utf-8", "replace")
            found = model.terminals(list(text.values()))
            known.update((k, found[w]) for k, w in text.items())
            per_word = np.fromiter((known[k] for k in keys), dtype=np.int64, count=len(keys))[which]
            total = np.concatenate([[0], np.cumsum(per_word)])
            rows = c.last - c.first
            several = np.unique(c.row_of_word() * len(keys) + which) // max(1, len(keys))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(c.first, rows),
                    pa.array(np.diff(c.bounds)),
                    pa.array(np.bincount(several, minlength=rows)),
                    pa.array(total[c.bounds[1:]] - total[c.bounds[:-1]]),
                ],
                ["doc_id", "n_pretokens", "n_distinct", "n_tokens"],
            )


def count_tokens(documents: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_distinct (pre-tokens), n_tokens.

    Null and empty texts have none. Rows are counted one by one, whatever their doc_id; other
    columns are ignored. `model` is the path of a SentencePiece model that every executor has.
    """
    source = plain(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(
        lambda b: _counts(b, model), "doc_id long, n_pretokens long, n_distinct long, n_tokens long"
    )
