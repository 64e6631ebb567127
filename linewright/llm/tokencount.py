"""Token counts under a unigram vocabulary without building the tokens.

A text's spaces become U+2581, one is put in front, and the text is cut before each U+2581, as a Metaspace pre-tokenizer
does. An Aho-Corasick automaton lists the vocabulary's matches in a segment by their end; dynamic programming keeps the best
score and its number of pieces for each end. Of equal scores the earliest start stays; a character that is no piece of its
own may be an unknown at the lowest score less 10, and neighbouring unknowns are one piece.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from linewright.llm.common import map_arrow, pieces

SPACE = "▁"
CACHE = 400_000
#: A vocabulary is shipped with every task.
MAX_PIECES = 2_000_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a sentencepiece model with their scores; control and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    found = [(p, s) for p, s in found if SPACE not in p[1:]]  # no segment holds a second one
    if len(found) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return found


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.tree = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.tree.add_word(piece, (len(piece), score))
        if len(self.tree):
            self.tree.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - 10
        self.cache: dict[str, tuple[int, int]] = {}

    def segment(self, s: str) -> tuple[int, int]:
        """Pieces and, of these, unknown ones."""
        n = len(s)
        ends: dict[int, list] = {}
        for end, m in self.tree.iter(s) if len(self.tree) else ():
            ends.setdefault(end, []).append(m)
        score, count, unknown, last = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            best, start, single = None, 0, False
            for length, x in ends.get(e - 1, ()):
                single |= length == 1
                if best is None or score[e - length] + x > best:
                    best, start = score[e - length] + x, e - length
            if not single and (best is None or score[e - 1] + self.unknown > best):
                score[e], last[e] = score[e - 1] + self.unknown, True
                new = not last[e - 1]
                count[e], unknown[e] = count[e - 1] + new, unknown[e - 1] + new
            else:
                score[e], count[e], unknown[e] = best, count[start] + 1, unknown[start]
        return count[n], unknown[n]

    def text(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        text = text.replace(" ", SPACE)
        total = unknown = 0
        for part in (text[1:] if text[0] == SPACE else text).split(SPACE):
            found = self.cache.get(part)
            if found is None:
                found = self.segment(SPACE + part)
                if len(part) < 200:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    self.cache[part] = found
            total += found[0]
            unknown += found[1]
        return total, unknown


_LAST: dict = {}


def _count(batches, vocabulary):
    if _LAST.get("key") != vocabulary:
        _LAST.update(key=vocabulary, value=Counter(vocabulary))
    counter = _LAST["value"]
    for b in pieces(batches):
        texts = [x or "" for x in b.column(1).to_pylist()]
        found = [counter.text(t) for t in texts]
        yield {"doc_id": b.column(0), "n_chars": [len(t) for t in texts], "n_tokens": [x for x, _ in found], "n_unknown": [x for _, x in found]}


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens, n_unknown for each row of docs (doc_id, text).

    A null or empty text counts 0; null and repeated doc_ids pass through; other columns are ignored. No shuffle: a task
    holds one run of texts and a bounded cache of segments. Time is linear in the text, however long a segment is.
    """
    return map_arrow(docs.select("doc_id", "text"), _count, "doc_id long, n_chars long, n_tokens long, n_unknown long", vocabulary)
