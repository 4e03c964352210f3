"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

A text is cut as a metaspace pre-tokenizer does: each blank becomes the mark, one goes in front where the text
does not begin with one, and a piece starts at each mark. Over a piece, an Aho-Corasick automaton
lists the vocabulary entries that end at each character, longest first; dynamic programming carries the
best score, the number of tokens of that path and whether it ends in an unknown one. Ties go to the entry
that starts first, as only a strictly better score replaces what is there; a character that no entry of its
length covers is unknown at the lowest score less ten, and unknown characters in a row are one token.
Pieces repeat, so counts of recent ones are kept; nothing but counts leaves a task.

Null and empty texts count 0. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from ragspark.llm.common import kept_in_worker, map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")
#: Pieces whose counts a worker keeps, in two generations.
CACHE = 1_000_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Entries of a sentencepiece file with a log probability each, the unknown entry first.

    A file of merges orders its entries but gives no probabilities. They are set by rule: the entry of rank
    ``r`` gets Zipf's ``-log(r + 10)``. Control and byte entries are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [("<unk>", 0.0)]
    for i in range(model.get_piece_size()):
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i), -log(len(out) + 10)))
    return out


class Counter:
    """Counts tokens of texts by a vocabulary of entries and scores; entry ``unknown`` stands for the rest."""

    def __init__(self, vocabulary: Iterable[tuple[str, float]], unknown: int = 0) -> None:
        import ahocorasick

        entries = list(vocabulary)
        self.lowest = min((s for _, s in entries), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, (entry, score) in enumerate(entries):
            if entry:  # a repeated entry counts as its last
                self.automaton.add_word(entry, (len(entry), score, i == unknown))
        self.automaton.make_automaton()
        self._known: dict[str, int] = {}
        self._older: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        size, singles, plain = len(text), 0, True
        scores, counts = [_NEVER] * (size + 1), [0] * (size + 1)
        scores[0] = 0.0
        for end, (length, score, unknown) in self.automaton.iter(text) if len(self.automaton) else ():
            # by end, longest first, so the earliest start first
            total = scores[end + 1 - length] + score
            if total > scores[end + 1]:
                scores[end + 1] = total
                counts[end + 1] = counts[end + 1 - length] + 1
            singles += length == 1
            plain &= not unknown
        # with an entry for each single character and no unknown one, that was all
        return counts[size] if plain and singles == size else self._with_unknown(text)

    def _with_unknown(self, text: str) -> int:
        size = len(text)
        best = [None] * (size + 1)  # (score, tokens, whether the last is unknown)
        best[0] = (0.0, 0, False)
        ends: list[list] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(text) if len(self.automaton) else ():
            ends[end].append(found)
        for end in range(size):
            chosen = None
            if not ends[end] or ends[end][-1][0] != 1:
                ends[end].append((1, self.lowest, True))
            for length, score, unknown in ends[end]:
                before = best[end + 1 - length]
                total = score + before[0]
                if chosen is None or total > chosen[0]:
                    chosen = (total, before[1] + (not (unknown and before[2])), unknown)
            best[end + 1] = chosen
        return best[size][1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        words = (text if text[0] in (" ", MARK) else MARK + text).replace(" ", MARK).split(MARK)
        known, older = self._known, self._older
        for word in words[1:]:
            n = known.get(word)
            if n is None:
                n = older.get(word)
                if n is None:
                    n = self.piece(MARK + word)
                if len(known) >= CACHE // 2:
                    self._older, self._known = known, {}
                    known, older = self._known, self._older
                known[word] = n
            total += n
        return total


def counted(docs: DataFrame, vocabulary: str | list[tuple[str, float]], text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens``; the vocabulary is given or a file's path."""

    def fresh():
        if isinstance(vocabulary, str):
            own = kept_in_worker(f"counter {vocabulary}", lambda: Counter(unigram_vocabulary(vocabulary)))
        else:
            own = Counter(vocabulary)
        return lambda texts: {"n_tokens": pa.array([own.count(t) for t in texts], pa.int64())}

    return map_texts(docs, text, fresh, "n_tokens long")
