"""Language ID by a byte convolutional network.

Letters of either case share a symbol, other ASCII characters are one separator, digits another, and each
byte above 0x7F is itself. A window is 128 bytes; windows overlap by three bytes, so that each position
of a text is the start of exactly one filter of each width. Filters of two, three and four bytes are
max-pooled over a window and a softmax layer votes; a text's result is the mean of its windows,
weighted by the letters they hold.

Training runs in numpy on a bounded, documented sample (:func:`training_windows`). Prediction never
multiplies: a filter over a pair of symbols is a row of a table, so a position costs five look-ups.

Null texts and texts without a letter give ``und`` with score 0. Equal texts give equal results. With no
labelled rows at all, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.llm.common import learns_from, map_texts

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
FILTERS = 8
EMBEDDED = 8
SYMBOLS = 156
#: Bound of the sample: documents of each language, windows of each document.
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6

_REACH = max(WIDTHS) - 1
_CHUNK = 96  # windows per pass; the looked-up rows then stay in cache


def symbol_table() -> np.ndarray:
    symbols = np.zeros(256, np.uint8)
    for i in range(26):
        symbols[ord("a") + i] = symbols[ord("A") + i] = i + 1
    symbols[ord("0") : ord("9") + 1] = 27
    symbols[128:] = np.arange(28, SYMBOLS)
    return symbols


_TABLE = symbol_table()


def positions(text: str) -> np.ndarray:
    """Symbols of a text behind a few separators, padded to whole strides.

    A filter at the end of a stream meets the separators of the next one, so streams of several
    texts can follow each other.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = -(-(len(raw) + _REACH) // STRIDE)
    out = np.zeros(count * STRIDE, np.uint8)
    out[_REACH : _REACH + len(raw)] = _TABLE[raw]
    return out


def windows_of(symbols: np.ndarray) -> np.ndarray:
    symbols = np.concatenate([symbols, np.zeros(_REACH, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(symbols, WINDOW)[::STRIDE]


def _most(outputs: np.ndarray) -> np.ndarray:
    """Maximum along the middle axis, by folding halves that may overlap."""
    while (size := outputs.shape[1]) > 1:
        half = (size + 1) // 2
        outputs = np.maximum(outputs[:, :half], outputs[:, size - half :])
    return outputs[:, 0]


@dataclass
class ByteNet:
    """Weights of the network and the languages in the order of its outputs."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages,
            draw(0.5, SYMBOLS, EMBEDDED),
            {w: draw(1 / np.sqrt(w * EMBEDDED), w * EMBEDDED, FILTERS) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            draw(0.1, FILTERS * len(WIDTHS), len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 128, seed: int = 7) -> None:
        """Adam on cross-entropy; gradients pass through the pooled position of each filter."""
        rng = np.random.default_rng(seed)
        weights = [self.embedding, *(self.filters[w] for w in WIDTHS), *(self.biases[w] for w in WIDTHS), self.dense, self.offset]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                rows = order[start : start + batch]
                step += 1
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for i, grad in enumerate(self._gradients(windows[rows], labels[rows])):
                    first[i] += 0.1 * (grad - first[i])
                    second[i] += 0.001 * (grad * grad - second[i])
                    weights[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)

    def _gradients(self, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n = len(symbols)
        looked_up = self.embedding[symbols]
        pooled, at, seen = [], {}, {}
        for w in WIDTHS:
            columns = np.concatenate([looked_up[:, k : k + STRIDE] for k in range(w)], axis=2)
            out = columns @ self.filters[w] + self.biases[w]
            at[w], seen[w] = out.argmax(axis=1), columns
            pooled.append(np.maximum(out.max(axis=1), 0))
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ self.dense + self.offset
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(n), labels] -= 1
        chance /= n
        back = (chance @ self.dense.T) * (hidden > 0)
        grad_embedding = np.zeros_like(self.embedding)
        of_filters, of_biases = [], []
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            picked = seen[w][rows, at[w]]
            of_filters.append(np.einsum("nfc,nf->cf", picked, g))
            of_biases.append(g.sum(axis=0))
            down = g[:, :, None] * self.filters[w].T[None]
            for k in range(w):
                np.add.at(grad_embedding, symbols[rows, at[w] + k], down[:, :, k * EMBEDDED : (k + 1) * EMBEDDED])
        return [grad_embedding, *of_filters, *of_biases, hidden.T @ chance, chance.sum(axis=0)]

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Per width: (offset, whether it is indexed by a pair, rows)."""
        out = []
        for w in WIDTHS:
            single = [self.embedding @ self.filters[w][k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(w)]
            single[0] = single[0] + self.biases[w]
            parts = []
            for k in range(0, w - 1, 2):
                pair = (single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS)
                parts.append((k, True, np.ascontiguousarray(pair, np.float32)))
            if w % 2:
                parts.append((w - 1, False, np.ascontiguousarray(single[w - 1], np.float32)))
            out.append(parts)
        return out

    def logits(self, symbols: np.ndarray, tables: list) -> np.ndarray:
        """Outputs for each window of a stream of symbols, as :func:`positions` pads it."""
        out = []
        symbols = np.concatenate([symbols, np.zeros(_REACH, np.uint8)])
        for start in range(0, len(symbols) - _REACH, _CHUNK * STRIDE):
            piece = symbols[start : start + _CHUNK * STRIDE + _REACH].astype(np.intp)
            n = (len(piece) - _REACH) // STRIDE
            pairs = piece[:-1] * SYMBOLS + piece[1:]
            pooled = []
            for parts in tables:
                total = None
                for offset, paired, rows in parts:
                    got = np.take(rows, (pairs if paired else piece)[offset : offset + n * STRIDE], axis=0, mode="clip")
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(np.maximum(_most(total.reshape(n, STRIDE, FILTERS)), 0))
            out.append(np.concatenate(pooled, axis=1) @ self.dense + self.offset)
        return np.concatenate(out)


def _predictor(net: ByteNet):
    import regex

    letter = regex.compile(r"\p{L}")
    tables = net.tables() if net.languages else []

    def predict(texts: list) -> dict[str, pa.Array]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        held, streams = [], []
        for i, text in enumerate(texts):
            if net.languages and text and letter.search(text):
                held.append(i)
                streams.append(positions(text))
        if held:
            counts = np.array([len(s) // STRIDE for s in streams])
            stream = np.concatenate(streams)
            logits = net.logits(stream, tables)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            is_letter = (stream > 0) & (stream != 27)
            weight = is_letter.reshape(-1, STRIDE).sum(axis=1).astype(np.float64)
            total = np.add.reduceat(weight, starts)
            mean = np.add.reduceat(logits * weight[:, None], starts, axis=0) / np.maximum(total, 1)[:, None]
            chance = np.exp(mean - mean.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            for k, i in enumerate(held):
                names[i], scores[i] = net.languages[best[k]], chance[k, best[k]]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return predict


def training_windows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = DOCS_PER_LANGUAGE,
    per_doc: int = WINDOWS_PER_DOC,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most ``per_language`` documents of each language, by hash of the id, ``per_doc`` windows spread over each.

    Rows whose id is null or whose crc32 modulo 3 is 1, and rows without a language or text, are left out. Of rows of one id
    and language the smallest text is taken, so the bound holds for ids that repeat. Windows with a quarter of letters or less teach nothing; a
    language of such texts alone is not learned.
    """
    rows = docs.filter(learns_from(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    named = rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")).distinct()
    counts = named.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    # hashes low enough to be among the first: a few times as many rows as are taken, whatever the corpus holds
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * per_language / r["count"]))])[F.col("lang")]
    hashed = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = (
        named.withColumn("hash", hashed)
        .filter(F.col("hash") <= share * float(1 << 53))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= per_language)
        .select("lang", "doc_id")
    )
    # at most ``per_language`` rows of each language
    taken = F.broadcast(chosen.select(F.col("lang").alias("__lang"), F.col("doc_id").alias("__id")))
    found = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"))
    found = found.join(taken, (F.col("lang") == F.col("__lang")) & (F.col("doc_id") == F.col("__id")))
    picked = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("text", "lang")

    def cut(batches):
        for batch in batches:
            got, names = [], []
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = windows_of(positions(value))
                own = own[(own > 0).sum(axis=1) > WINDOW // 4]
                for k in np.unique(np.linspace(0, len(own) - 1, per_doc).astype(int)) if len(own) else []:
                    got.append(own[k].tobytes())
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(names, pa.string())], ["win", "lang"])

    table = picked.mapInArrow(cut, "win binary, lang string").orderBy("lang", "win").toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {name: i for i, name in enumerate(languages)}
    windows = np.frombuffer(b"".join(table.column("win").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return languages, windows, np.array([place[n] for n in names], np.int64)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> ByteNet:
    languages, windows, labels = training_windows(docs, doc_id, text, lang, **bounds)
    net = ByteNet.fresh(languages)
    if languages:
        share = np.bincount(labels, minlength=len(languages))
        # each language weighs the same: rows of the rarer ones are repeated
        again = np.concatenate([np.resize(np.flatnonzero(labels == i), share.max()) for i in range(len(languages))])
        net.fit(windows[again], labels[again])
    return net


def predict(docs: DataFrame, net: ByteNet, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the text is replaced by them unless ``keep_text``."""
    source = docs.withColumn("__text", F.col(text)) if keep_text else docs.withColumnRenamed(text, "__text")
    return map_texts(source, "__text", lambda: _predictor(net), "lang_pred string, score double")
