"""Phrase lists of any length against texts, without a phrase in the plan.

A phrase is found as the checks find one: as a bag of words, that is where each of its words is a word of the text. The texts are dealt to
shards by their key and the list to parts by its bags, and each shard meets each part in a task of its own, which holds that part and
streams the texts past it. There a bag is posted under its rarest word, the one that fewest of the task's first texts hold; a text meets
only the bags posted under its own words, and is asked for their other words, the next rarest first. Equal bags are tested once. The
phrases are a table like the texts: nothing is collected or written into the plan.

Texts of one key are one text. Null and empty texts match nothing, nor does a phrase without a word. A phrase given twice is found twice, by
its ids. Keys and phrase ids must not be null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions.text import tokens
from ragspark.session import stored

# Estimated bytes of texts in a shard, and the fewest shards; phrases in a part of the list.
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 32
PART_PHRASES = 200_000
# Cells of texts by words, and bags to be tested, that a task holds at a time.
_CELLS = 8_000_000
_TESTS = 2_000_000
# Rows of a batch that a task hands back.
_ROWS = 100_000


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class _Bags:
    """A part of the list, and which bags are to be tested for a word."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        self.rows = pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]
        lines = self.rows.column(0).dictionary_encode()
        of_row = lines.indices.to_numpy()
        self.row_order = np.argsort(of_row, kind="stable")
        self.n_rows = np.bincount(of_row, minlength=len(lines.dictionary))
        self.row_start = np.cumsum(self.n_rows) - self.n_rows
        listed = pc.split_pattern(lines.dictionary, " ")
        coded = listed.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.size = pc.list_value_length(listed).to_numpy()
        self.start = np.cumsum(self.size) - self.size

    def post(self, texts: np.ndarray) -> None:
        """Order the words of each bag by the number of texts that hold them."""
        bag = np.repeat(np.arange(len(self.size)), self.size)
        self.codes = self.codes[np.lexsort((self.codes, texts[self.codes], bag))]
        under = self.codes[self.start]
        self.posted = np.argsort(under, kind="stable")
        self.n_posted = np.bincount(under, minlength=len(self.words))
        self.post_start = np.cumsum(self.n_posted) - self.n_posted

    def matches(self, text: np.ndarray, word: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and the bags they hold, of the words of some texts; ``held`` is false everywhere before and after."""
        held[text, word] = True
        n = self.n_posted[word]
        asked, bag = np.repeat(text, n), self.posted[_ranges(self.post_start[word], n)]
        whole, at = [], 1
        while len(bag):
            done = self.size[bag] == at
            whole.append((asked[done], bag[done]))
            asked, bag = asked[~done], bag[~done]
            left = held[asked, self.codes[self.start[bag] + at]]
            asked, bag, at = asked[left], bag[left], at + 1
        held[text, word] = False
        none = np.empty(0, np.int64)
        return np.concatenate([none, *[w[0] for w in whole]]), np.concatenate([none, *[w[1] for w in whole]])

    def found(self, keys: pa.Array, text: np.ndarray, word: np.ndarray) -> Iterator[list[pa.Array]]:
        """Key and list columns of the matches of texts, whose words are given in the order of the texts, each once."""
        most = max(1, _CELLS // len(self.words))
        held = np.zeros((min(most, len(keys)), len(self.words)), dtype=bool)
        tests = np.cumsum(np.bincount(text, weights=self.n_posted[word], minlength=len(keys)))
        group = np.stack([np.arange(len(keys)) // most, tests // _TESTS])
        cuts = [0, *(np.flatnonzero(np.diff(group).any(axis=0)) + 1), len(keys)]
        ends = np.searchsorted(text, cuts)
        for first, a, b in zip(cuts, ends, ends[1:]):
            local, bag = self.matches(text[a:b] - first, word[a:b], held)
            n = self.n_rows[bag]
            who, row = np.repeat(local + first, n), self.row_order[_ranges(self.row_start[bag], n)]
            order = np.argsort(who, kind="stable")
            for i in range(0, len(order), _ROWS):
                some = order[i : i + _ROWS]
                taken = self.rows.take(pa.array(row[some]))
                yield [keys.take(pa.array(who[some])), *taken.columns[1:]]


def _each_once(text: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.unique(text * words + word), words)


def _shards(texts: DataFrame) -> int:
    """Shards of about ``SHARD_BYTES`` by the optimizer's estimate, which costs no job."""
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(LEAST_SHARDS, -(-size // SHARD_BYTES)) if size < 1 << 60 else LEAST_SHARDS


def phrase_matches(
    texts: DataFrame,
    phrases: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrase_id: str = "phrase_id",
    phrase: str = "phrase",
    carry: list[str] | None = None,
) -> DataFrame:
    """``key, phrase_id`` of every phrase whose words are all words of the text.

    Columns of ``phrases`` named in ``carry`` come along, which saves joining them.
    """
    brought = [phrase_id, *(carry or [])]
    line = F.array_join(F.sort_array(F.array_distinct(tokens(F.col(phrase)))), " ")
    named = stored(phrases.select(line.alias("__line"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(brought)]).filter("__line <> '' AND __c0 IS NOT NULL"), "phrases")
    parts, shards = max(1, -(-named.count() // PART_PHRASES)), _shards(texts.select(key, text))

    kinds = [phrases.schema[c].dataType for c in brought]
    key_type = texts.schema[key].dataType
    part, shard = F.pmod(F.xxhash64("__line"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("__key"), F.lit(shards)).cast("int")
    lists = named.select(
        F.explode(F.sequence(part * shards, part * shards + (shards - 1))).alias("__cell"),
        F.lit(False).alias("__asks"),
        "__line",
        *[f"__c{i}" for i in range(len(brought))],
        F.lit(None).cast(key_type).alias("__key"),
        F.lit(None).cast("array<string>").alias("__words"),
    )
    asked = texts.select(F.col(key).alias("__key"), F.array_distinct(tokens(F.col(text))).alias("__words")).filter("__key IS NOT NULL").select(
        F.explode(F.sequence(shard, shard + (parts - 1) * shards, F.lit(shards))).alias("__cell"),
        F.lit(True).alias("__asks"),
        F.lit(None).cast("string").alias("__line"),
        *[F.lit(None).cast(k).alias(f"__c{i}") for i, k in enumerate(kinds)],
        "__key",
        "__words",
    )
    schema = T.StructType([T.StructField(key, key_type), *[T.StructField(c, k) for c, k in zip(brought, kinds)]])
    last = 2 + 1 + len(brought)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, bags, posted = [], None, False
        # the last text so far, which may go on in the next batch
        key_held, words_held = None, None

        def told(keys: pa.Array, of: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
            for columns in bags.found(keys, of, word):
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            own = int(np.searchsorted(batch.column(1).to_numpy(zero_copy_only=False), True))
            if own:
                listed.append(pa.RecordBatch.from_arrays(batch.slice(0, own).columns[2:last], names=["line", *brought]))
            if own == len(batch) or not listed:
                continue
            bags = bags or _Bags(listed)
            keys, lists_in = batch.column(last).slice(own), batch.column(last + 1).slice(own)
            word = pc.index_in(lists_in.flatten(), value_set=bags.words)
            known = word.is_valid().to_numpy(zero_copy_only=False)
            of_row = np.repeat(np.arange(len(keys)), pc.list_value_length(lists_in).fill_null(0).to_numpy())
            starts = np.concatenate([[True], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)])
            of, word = (np.cumsum(starts) - 1)[of_row[known]], word.drop_null().to_numpy().astype(np.int64)
            each = keys.take(pa.array(np.flatnonzero(starts)))
            if key_held is not None:
                if key_held[0] != each[0]:
                    each, of = pa.concat_arrays([key_held, each]), of + 1
                of, word = np.concatenate([np.zeros(len(words_held), np.int64), of]), np.concatenate([words_held, word])
            of, word = _each_once(of, word, len(bags.words))
            if not posted:
                bags.post(np.bincount(word, minlength=len(bags.words)))
                posted = True
            end = int(np.searchsorted(of, len(each) - 1))
            key_held, words_held = each.slice(len(each) - 1), word[end:]
            if len(each) > 1:
                yield from told(each.slice(0, len(each) - 1), of[:end], word[:end])
        if key_held is not None:
            yield from told(key_held, np.zeros(len(words_held), np.int64), words_held)

    return lists.union(asked).repartitionById(parts * shards, "__cell").sortWithinPartitions("__asks", "__key").mapInArrow(run, schema)
