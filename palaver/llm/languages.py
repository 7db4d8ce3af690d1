"""Problem 4: the language of documents and of the lines of mixed ones.

Method: error-correcting output codes. The classes (language and script) have codewords; one linear classifier on character n-grams of
words predicts each bit; loss-weighted decoding chooses the nearest codeword and flags a line whose second codeword is nearly as close.
train.py fits the classifiers; models/languages.json holds them.
"""

from __future__ import annotations

import itertools
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, speech

MODEL = "languages.json"
CLASSES = ("en", "hi-Latn", "hi-Deva", "ja")
#: Exhaustive code of four classes: every split in two, once; Hamming distance 4 between any two codewords.
CODE = np.array([[1 if (b >> c) & 1 else -1 for b in range(1, 8)] for c in range(3)] + [[-1] * 7]) * 1.0
#: Second best class this near in loss: ambiguous.
NEAR = 0.7
MIXED_SHARE = (1, 5)
_TOKEN = re.compile(r"\n|[ऀ-ॣ]+|[ぁ-ゟ]{1,4}|[゠-ヿ]{1,5}|[㐀-鿿々]{1,2}|[^\W\d_぀-ヿ㐀-鿿ऀ-ॣ]+")
_ADDRESS = re.compile(r"[!-~]*@[!-~]*")
#: Capital words within a sentence: names and loanwords, which don't count.
_PROPER = re.compile(r"(?<=[a-z0-9,] )\"?[A-Z][A-Za-zÀ-ɏ'-]*(?:,? (?:[0-9]+[A-Z]?,? )*[A-Z][A-Za-zÀ-ɏ'-]*)*")
_OPENER = re.compile(speech.OPENERS, re.I)


def grams(word: str) -> list[str]:
    """The n-grams of one word, its ends marked."""
    w = f"^{word}$"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or w[i] not in "^$"] + [w]


class Model:
    def __init__(self, weights: dict[str, list[float]], bias: list[float], scale: float):
        self.w, self.bias, self.scale = weights, np.array(bias), scale
        self.ids: dict[str, int] = {}
        self.sums = np.zeros((1024, len(bias) + 1))

    @classmethod
    def load(cls) -> Model:
        from importlib.resources import files

        m = json.loads(files(__package__).joinpath("models", MODEL).read_text("utf-8"))
        return cls(m["weights"], m["bias"], m["scale"])

    def _word(self, word: str) -> int:
        """The word's row of sums; the table starts anew when it is large, so memory is bounded."""
        i = len(self.ids)
        if i >= len(self.sums):
            self.sums = np.vstack([self.sums, np.zeros_like(self.sums)])
        g = grams(word)
        known = [self.w[x] for x in g if x in self.w]
        self.sums[i, :-1] = np.sum(known, axis=0) if known else 0.0
        self.sums[i, -1] = len(g)
        self.ids[word] = i
        return i

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class losses (lines x classes) and number of n-grams of each line. Letters' case doesn't count."""
        if len(self.ids) > 400_000:
            self.ids = {}
            self.sums = np.zeros((1024, len(self.bias) + 1))
        ids, get = self.ids, self.ids.get
        starts, flat = [], []
        for t in texts:
            starts.append(len(flat))
            words = _TOKEN.findall(t.lower())
            row = [get(w, -1) for w in words]
            if -1 in row:
                row = [ids[w] if w in ids else self._word(w) for w in words]
            flat += row
        bounds = [*starts, len(flat)]
        total = np.zeros((len(texts), self.sums.shape[1]))
        if flat:
            run = np.vstack([np.zeros((1, self.sums.shape[1])), np.cumsum(self.sums[flat], axis=0)])
            total = run[bounds[1:]] - run[bounds[:-1]]
        n = np.maximum(total[:, -1:], 1.0)
        margins = (total[:, :-1] / n + self.bias) * self.scale
        return np.logaddexp(0, -margins[:, None, :] * CODE[None]).sum(axis=2), total[:, -1]


def classify(model: Model, texts: list[str]) -> list[tuple[str, float, bool, float]]:
    """(class, confidence, ambiguous, n-grams seen) of each text."""
    if not texts:
        return []
    loss, n = model.lines(texts)
    order = np.sort(loss, axis=1)
    conf = 1 / np.exp(order[:, :1] - order).sum(axis=1)
    return [(CLASSES[b], c, u, s) for b, c, u, s in zip(loss.argmin(axis=1).tolist(), conf.tolist(), (order[:, 1] - order[:, 0] < NEAR).tolist(), n.tolist(), strict=True)]


def _bare(text: str) -> str:
    text = _ADDRESS.sub(" ", text) if "@" in text else text
    return _PROPER.sub(" ", _OPENER.sub(" ", text))


def label_lines(folded: str, model: Model) -> list[tuple[int, str, float, bool]]:
    """(line_no, language, confidence, ambiguous) of the spoken lines of a folded text. An unlabelled line too short to tell goes with the line above."""
    from .lines import blank_notes, lines

    spoken = [x for x in lines(folded) if x.spoken]
    got = classify(model, [_bare(blank_notes(folded[x.start : x.end])) for x in spoken])
    out: list[tuple[int, str, float, bool]] = []
    for x, (cls, conf, unsure, seen) in zip(spoken, got, strict=True):
        lang = cls.split("-")[0]
        if out and x.label is None and (unsure or seen < 40) and out[-1][0] == x.no - 1 and lang != out[-1][1]:
            lang, conf = out[-1][1], min(conf, 0.5)
        elif not seen:
            lang, conf, unsure = out[-1][1] if out else "en", 0.0, True
        out.append((x.no, lang, conf, unsure))
    return out


def whole(found: list[tuple[int, str, float, bool]]) -> tuple[str | None, float]:
    """Language and confidence of a document by its lines; mixed if a second language has at least a fifth of them. None without spoken lines."""
    if not found:
        return None, 0.0
    by: dict[str, int] = {}
    for _, lang, _, _ in found:
        by[lang] = by.get(lang, 0) + 1
    ranked = sorted(by.values(), reverse=True)
    mixed = len(ranked) > 1 and ranked[1] * MIXED_SHARE[1] >= len(found) * MIXED_SHARE[0]
    conf = math.fsum(c for _, _, c, _ in found) / len(found)
    return ("mixed" if mixed else max(by, key=by.__getitem__)), conf


# Notations of the labels.
NOTATIONS = {
    "ja": ("ja", "jp", "jpn", "jap", "japanese", "日本語", "にほんご", "nihongo", "जापानी"),
    "en": ("en", "eng", "english", "英語", "अंग्रेज़ी", "अंग्रेजी"),
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी", "ヒンディー語", "hinglish"),
    "mixed": ("mixed", "mix", "mul", "multi", "multilingual", "混在", "मिश्रित"),
    "": ("", "und", "auto", "unknown", "unk", "none", "null", "n/a", "na", "-", "?", "undetermined"),
}


def normal_label(c: Column) -> Column:
    """ja, en, hi or mixed for any notation of them, null if the label is missing, else the label in lower case without its region."""
    low = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "[\\s\\u3000\\u00a0]+", " "))), "[-_](?:[a-z]{2}|latn|deva|jpan|hans)$", "")
    table = F.create_map(*itertools.chain(*((F.lit(x), F.lit(k)) for k, v in NOTATIONS.items() for x in v)))
    return F.nullif(F.coalesce(table[F.coalesce(low, F.lit(""))], low), F.lit(""))


def _label():
    from .canon import aligned

    model = Model.load()

    def f(key, text, label):
        found = label_lines(aligned(text or "")[0], model)
        lang, conf = whole(found)
        out = [(key, 0, lang, conf, False, label)]
        if lang == "mixed":
            out += [(key, no, got, c, unsure, label) for no, got, c, unsure in found]
        return out

    return f


def languages(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key, line_no (0: the document), lang, confidence, ambiguous, label (as normal_label gives it). Rows for lines only where the document is mixed.

    A document without speech has a null lang and confidence 0. Null keys give no row; repeated rows of a key count once. One pass, no shuffle but for repeats.
    """
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), normal_label(F.col(label)).alias("l"))
    return frames.rows_out(
        d, _label, f"{key} string, line_no int, lang string, confidence double, ambiguous boolean, label string",
        [(key, pa.string()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("label", pa.string())],
    ).dropDuplicates([key, "line_no", "lang", "label"])


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return languages(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript", "language"]), "request_id", "transcript", "language")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).where("lang IS NOT NULL AND (line_no > 0 OR NOT (lang <=> label))").select("request_id", "line_no", "lang").distinct()


QUERIES = {"p4_found": p4_found, "p4_languages": _requests}
SQL: dict[str, str] = {}
