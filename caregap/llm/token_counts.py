"""Token counts: whole-token words are counted by lookup, only the rest is merged by the library."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts, texts_only

SPACE = "▁"
_COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"
# Words kept per Python worker besides the proven ones; a full memo is dropped and filled anew.
MEMO_WORDS = 500_000
MEMO_CHARS = 64


class PieceCounter(dict):
    """Counts the tokens of a text by summing over its pre-tokens.

    A pre-token is a run of spaces with the word behind it; line ends stand for
    themselves. Counting them one by one is right if no merge can cross from one
    to the next, that is, if no vocabulary string has a space mark behind another
    character, or holds a line end. ``__init__`` proves that for the given model
    and refuses a model where it does not hold.

    As a dict it maps a pre-token to its number of tokens: a plain key is a word
    with one space before it, a key that starts with a line end is that line end
    and the word right behind it.
    """

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = [p for p in pieces if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p or " " in p]
        if crossing or len(self.library.encode("\n")) != 2:
            raise ValueError(f"pre-tokens of this model are not independent: {crossing[:5]}")
        self.proven = dict.fromkeys(self.whole_tokens(pieces), 1)
        self.update(self.proven)

    def whole_tokens(self, pieces: list[str]) -> list[str]:
        """Words (without their space mark) that the library itself encodes as exactly one token."""
        words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
        return [w for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True) if len(ids) == 1]

    def __missing__(self, key: str) -> int:
        if not key:
            n = 1  # a space mark alone
        elif key[0] == "\n":
            n = len(self.library.encode(key)) - 1  # without the leading space mark
        else:
            n = len(self.library.encode(key))
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text or "\0" in text:
            return len(self.library.encode(text))
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return sum(map(self._odd, re.findall("\n| +[^ \n]*|[^ \n]+", " " + text)))
        return sum(map(self.__getitem__, text.replace("\n", " \n").split(" ")))

    def _odd(self, part: str) -> int:
        if part == "\n":
            return 1
        return self[part[1:]] if part[0] == " " else self["\n" + part] - 1


@lru_cache(maxsize=2)
def _counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def token_counts(
    docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text under a sentencepiece BPE model, as the library counts them.

    No begin, end or other special tokens are added; strings that look like
    special tokens are ordinary text, as the library has it. ``model`` is a path
    that exists on every worker.

    One map over the rows: no shuffle, memory bounded by a slice of texts and the
    memo of words. Defined cases: null text counts as empty (0 bytes, 0 tokens);
    null and repeated ids keep their rows; an empty table gives no rows; other
    columns are not read.

    Returns doc_id, n_bytes, n_tokens, over_limit.
    """

    def work(ids: pa.Array, texts: list[bytes | None]):
        counter = _counter(model)
        yield {
            "doc_id": ids,
            "n_bytes": [len(t or b"") for t in texts],
            "n_tokens": [counter.count((t or b"").decode("utf-8", "replace")) for t in texts],
        }

    return map_texts(texts_only(docs, id_col, text_col), work, _COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
