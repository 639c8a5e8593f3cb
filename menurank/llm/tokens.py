"""Token counts without tokens: Viterbi over unigram vocabulary matches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNKNOWN_PENALTY = 10.0


#: Offset of the ranks in Zipf's law as Mandelbrot gives it.
ZIPF_OFFSET = 2.7


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the normal pieces of a SentencePiece model file.

    A unigram file's scores are log probabilities and are taken as they are. A file of merges
    has ranks (0, -1, -2, ...) in their place, which don't add up along a text; then the score is the log
    of Zipf's law, -log(rank + 1 + ZIPF_OFFSET), as merges are in the order of frequency. Nothing is trained.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    if pieces and all(s <= 0 and s == int(s) for _, s in pieces) and 2 * len({s for _, s in pieces}) > len(pieces):
        return [(piece, -math.log(1 - score + ZIPF_OFFSET)) for piece, score in pieces]
    return pieces


class Counter(dict):
    """Unit -> (best score, pieces), computed where it is missing; forgets all when it is full."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 400_000) -> None:
        import ahocorasick

        super().__init__()
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.most = most
        # if no piece has a space sign after another character, no piece crosses two units
        self.units = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in vocabulary)

    def __missing__(self, unit: str) -> tuple[float, int]:
        """Matches come by end and, for one end, from the earliest start on, and a later one must be better: the
        first of equals stays. A character that is no piece stands for its bytes."""
        n = len(unit)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        reached, at = 0, 0
        single, unknown = self.single, self.unknown

        def close(upto: int) -> None:
            """Give the ends up to `upto` their unknown character, the latest start of each."""
            nonlocal reached
            for e in range(reached + 1, upto + 1):
                c = unit[e - 1]
                if c not in single:
                    score = best[e - 1] + unknown
                    if not pieces[e] or score > best[e]:
                        best[e], pieces[e] = score, pieces[e - 1] + len(c.encode("utf-8", "surrogatepass"))
            reached = max(reached, upto)

        for last, (length, score) in self.machine.iter(unit):
            end = last + 1
            if end - 1 > reached:
                close(end - 1)
            score += best[end - length]
            if not pieces[end] or score > best[end]:
                best[end], pieces[end] = score, pieces[end - length] + 1
        close(n)
        if len(self) >= self.most:
            self.clear()
        self[unit] = out = (best[n], pieces[n])
        return out

    def text(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        found = [self[u] for u in (UNIT.findall(marked) if self.units else [marked])]
        return sum(s for s, _ in found), sum(n for _, n in found)


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_score): pieces of the best segmentation of each whole text, and its score.

    The vocabulary, of fixed size, is sent to the tasks. A text starts with a space sign and
    spaces are space signs, as the tokenizer does without other normalisation. Of segmentations with
    equal scores the one whose last piece starts earliest stays, from the end on. Null and
    empty texts have no tokens. A very long text is segmented whole, unit by unit where no piece crosses units.
    Repeated rows are rows of their own, the id may be of any type, other columns are
    ignored, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            found = [counter.text(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], [id_col, "n_tokens", "token_score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, token_score double")
