"""Language of texts and of their parts.

Words are runs of letters. The script of a word's first letter, by ranges of code points, narrows the languages to
those whose training text uses that script. Each candidate scores the word by the log probabilities of its byte
trigrams, and a Viterbi pass with a penalty for switching labels the words of a text with languages, so that mixed
texts fall into spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, code_points, lower_ascii, text_buffers
from .bpe import class_table

#: Labelled rows that the model is trained on at most: those with the least hash of doc_id, text and lang.
TRAIN_ROWS = 4000
#: Words that the Viterbi pass holds at once: the scores of longer texts are carried on from block to block.
BLOCK_WORDS = 1 << 17
#: Bytes of text looked at together: about the words of one block.
BLOCK_BYTES = 3 << 18
#: Buckets of hashed trigrams; the model holds this many floats for each language.
BUCKETS = 1 << 16
#: What a change of language costs, in nats, and what one word may say against a language at most.
SWITCH, WORST = 12.0, 12.0
#: A language uses a script if this share of its training words is written in it.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

# First code points of scripts' main ranges, each up to the next entry.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
_SCRIPT_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_OF = np.array([_SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


@dataclass(frozen=True)
class Model:
    """Languages, log probabilities (buckets x languages) and which scripts (scripts x languages) each uses."""

    languages: list[str]
    logp: np.ndarray
    uses: np.ndarray


@dataclass(frozen=True)
class LetterRuns:
    first: np.ndarray  # first word of each text, one more at the end
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    gram: np.ndarray  # bucket of each trigram
    gram_first: np.ndarray  # first trigram of each word, one more at the end


def letter_runs(body: np.ndarray, off: np.ndarray) -> LetterRuns:
    """The words of all texts with their scripts and trigrams. A word of n bytes has n trigrams (it is framed by blanks)."""
    at, cps = code_points(body)
    kind = class_table()[cps]
    letter_cp = (kind == 0) | (kind >= 6)
    letter = np.zeros(len(body) + 2, bool)
    if len(at):
        letter[1:-1] = np.repeat(letter_cp, np.diff(np.append(at, len(body))))
    inner = off[(off > 0) & (off < len(body))]
    start, end = letter[1:-1] & ~letter[:-2], letter[1:-1] & ~letter[2:]
    start[inner] |= letter[1:-1][inner]
    end[inner - 1] |= letter[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    script = _SCRIPT_OF[np.maximum(np.searchsorted(_SCRIPT_FROM, cps[np.searchsorted(at, starts)], "right") - 1, 0)]
    low = lower_ascii(body).astype(np.uint32)
    before, after = np.roll(low, 1), np.roll(low, -1)
    before[start] = 32
    after[end] = 32
    inside = np.flatnonzero(letter[1:-1])
    x = (before[inside] << np.uint32(16)) | (low[inside] << np.uint32(8)) | after[inside]
    x = x * np.uint32(0x9E3779B1)
    size = ends - starts
    gram_first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=gram_first[1:])
    return LetterRuns(np.searchsorted(starts, off), starts, ends, script, (x >> np.uint32(16)).astype(np.int32), gram_first)


def labelled(doc_id: str = "doc_id") -> Column:
    """Rows outside the held-out third."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``most`` rows with text and lang outside the held-out third; repeated rows among them count once.

    Trigrams and scripts are counted where the rows are; only the counts, as many as the model has numbers, come here.
    """
    rows = docs.filter(labelled() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.xxhash64("doc_id", "text", "lang").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    near = rows.select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]
    if near is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_SCRIPT_NAMES), 0), bool))
    sample = rows.filter(F.col("h") <= F.lit(near)).groupBy("h").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            runs = letter_runs(*text_buffers(batch.column(1)))
            coded = batch.column(0).dictionary_encode()
            word_lang = np.repeat(coded.indices.to_numpy(), np.diff(runs.first))
            gram_lang = np.repeat(word_lang, np.diff(runs.gram_first))
            slots = BUCKETS + len(_SCRIPT_NAMES)  # scripts are counted behind the trigrams
            at = np.concatenate([gram_lang.astype(np.int64) * slots + runs.gram, word_lang.astype(np.int64) * slots + BUCKETS + runs.script])
            at, count = np.unique(at, return_counts=True)
            seen = np.unique(coded.indices.to_numpy())  # a language of texts without letters is one too
            lang = np.concatenate([at // slots, seen])
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(lang)), pa.array(np.concatenate([at % slots, np.zeros(len(seen))]).astype(np.int32)), pa.array(np.concatenate([count, np.zeros(len(seen))]).astype(np.int64))],
                ["lang", "slot", "n"],
            )

    found = sample.select("lang", "text").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    coded = found.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(coded.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in coded.dictionary.to_pylist()])
    counts = np.zeros((BUCKETS + len(_SCRIPT_NAMES), len(languages)))
    counts[found.column("slot").to_numpy(), place[coded.indices.to_numpy()]] = found.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    return Model(languages, logp.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best label of each word, and the scores at each text's end; ``score`` is words x labels, texts lie one after another
    from ``first`` and go on from the scores ``before``. A label that a word excludes (-inf) is never its own."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    states = score.shape[1]
    back = np.empty(score.shape, np.int16 if states < 1 << 15 else np.int32)
    value = np.zeros((len(order), states), np.float32) if before is None else before[order].astype(np.float32)
    ids = np.arange(states, dtype=back.dtype)
    for t, m in enumerate(live):
        v, at = value[:m], begin[:m] + t
        top = v.argmax(1)
        move = v[np.arange(m), top] - np.float32(switch)
        stay = v >= move[:, None]
        back[at] = np.where(stay, ids, top[:, None])
        value[:m] = np.where(stay, v, move[:, None]) + score[at]
    label = np.zeros(len(score), back.dtype)
    state = value.argmax(1).astype(back.dtype)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        label[at] = state[:m]
        state[:m] = back[at, state[:m]]
    out = np.empty_like(value)
    out[order] = value
    return label, out


def word_scores(model: Model, runs: LetterRuns, a: int, b: int) -> np.ndarray:
    """Scores of the words a to b: what the best of a word's languages gains over the others, ``WORST`` at most; -inf where
    its script excludes a language, 0 for all where it excludes every one."""
    score = np.empty((b - a, len(model.languages)), np.float32)
    gram, edge = runs.gram[runs.gram_first[a] : runs.gram_first[b]], runs.gram_first[a:b] - runs.gram_first[a]
    for j in range(score.shape[1]):
        score[:, j] = np.add.reduceat(model.logp[:, j][gram], edge)
    uses = model.uses[runs.script[a:b]]
    none = ~uses.any(1)
    score[none] = 0
    out = ~uses & ~none[:, None]
    score[out] = -np.inf
    score = np.maximum(score - score.max(1, keepdims=True), np.float32(-WORST))
    score[out] = -np.inf
    return score


def label_words(model: Model, runs: LetterRuns) -> tuple[np.ndarray, np.ndarray]:
    """Label of each word, and whether its script is one that a learned language uses."""
    words = len(runs.starts)
    label, known = np.zeros(words, np.int32), model.uses[runs.script].any(1)
    length, a = np.diff(runs.first), 0
    while a < len(length):
        # Texts together as far as a block holds them; a longer one alone, block by block.
        b = max(a + 1, int(np.searchsorted(runs.first, runs.first[a] + BLOCK_WORDS, "right")) - 1)
        low, high, value = int(runs.first[a]), int(runs.first[b]), None
        if b == a + 1:
            for w in range(low, high, BLOCK_WORDS):
                to = min(w + BLOCK_WORDS, high)
                label[w:to], value = viterbi(word_scores(model, runs, w, to), np.array([0, to - w]), before=value)
        elif high > low:
            label[low:high], _ = viterbi(word_scores(model, runs, low, high), runs.first[a : b + 1] - low)
        a = b
    return label, known


def _predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, LetterRuns, np.ndarray]:
    runs = letter_runs(*text_buffers(column))
    texts = len(runs.first) - 1
    if not model.languages:
        return [UNDETERMINED] * texts, np.zeros(texts), runs, np.zeros(len(runs.starts), np.int32)
    label, known = label_words(model, runs)
    row = np.repeat(np.arange(texts), np.diff(runs.first))
    size = (runs.ends - runs.starts).astype(np.float64)
    mass = np.bincount(row * len(model.languages) + label, size * known, texts * len(model.languages)).reshape(texts, -1)
    total = np.bincount(row, size, texts)
    best = mass.argmax(1)
    score = mass[np.arange(texts), best] / np.maximum(total, 1)
    names = [model.languages[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist(), strict=True)]
    return names, score, runs, label


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, ``held_out``, ``lang_pred``, ``score`` of every row, and with ``spans`` the labelled spans in bytes.

    ``score`` is the share of the text's letters (in bytes) labelled with the language that most of them have. A null
    text or one without a letter is ``und`` with score 0; words of a script that no learned language uses count
    against the score; without any training row all is ``und``. Ties go to the first language by name. Repeated rows
    are each answered, a null id is kept (and not held out), an empty table gives none; lang, source and doc_id are
    not looked at. A word is never labelled with a language whose training text does not use its script, unless none
    does. Viterbi holds ``BLOCK_WORDS`` words at once; a longer text is read back block by block, each from the best score
    at its end. A text is held whole by one task, at about 40 bytes of memory a byte where it is longer than a batch.
    """
    kind = ", spans array<struct<start: int, end: int, lang: string>>" * spans

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BLOCK_BYTES):
            names, score, runs, label = _predict(model, batch.column(2))
            out, cols = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"]
            if spans:
                _, off = text_buffers(batch.column(2))
                parts = []
                for i in range(batch.num_rows):
                    a, b = runs.first[i], runs.first[i + 1]
                    turns = np.flatnonzero(np.append(True, label[a + 1 : b] != label[a : b - 1])) + a if b > a and model.languages else []
                    ends = np.append(turns[1:], b) - 1 if len(turns) else []
                    parts.append([{"start": int(runs.starts[s] - off[i]), "end": int(runs.ends[e] - off[i]), "lang": model.languages[label[s]]} for s, e in zip(turns, ends, strict=True)])
                out.append(pa.array(parts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                cols.append("spans")
            yield pa.RecordBatch.from_arrays(out, cols)

    held = F.coalesce(~labelled(), F.lit(False)).alias("held_out")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + kind)


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, with a language other than ``und`` and a score of ``least`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BLOCK_BYTES):
            names, score, _, _ = _predict(model, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
