"""Quality rules from tokeniser fertility.

Each whole text is split into words; a public piece vocabulary with byte fallback tokenises every word by itself
(with its word mark), and a document gets

* characters per token: how much a token of the vocabulary covers;
* byte-fallback share: the share of tokens that stand for single bytes;
* token entropy in bits, and its share of the most that so many tokens can have.

A document is kept if its base counts pass and its measures lie in the bands. Per language and size class (power of two of the
token count) the middle of all documents of the corpus sets them: so many robust deviations below the median of characters per token or of
token entropy, or so many above that of characters per token or of the byte-fallback share, reject. A corpus that is mostly clean
moves none: equal texts of a language count once, and deviations have a least value, so that copies and near copies do not
narrow the bands. A class of fewer than `least` distinct texts takes in the neighbouring sizes, else the whole language. Where that
has too few, too, fixed limits hold (parameter: per script, and per language whose fertility under the vocabulary differs), together with the
entropy band of the whole script, if that has enough. The language is a column of the table (null: the script takes its place).

Null texts count as having no words: all counts 0, base_failed true, kept false, measures null. Texts of any
length are measured whole; equal texts of one language get equal rows; other columns are carried along by `keep`.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Memo, small_side, stash, text_map

SYMBOLS = "#*$%&|<>"
SCRIPTS = ("Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Han", "Hiragana", "Katakana")

#: By dominant script, or by language and script where that language differs: least and most characters per token, most byte
#: fallback, least entropy in bits (for texts so short that it exceeds SHORT of the most that their tokens can have: that share).
BANDS = {
    "Latin": (1.2, 8.0, 0.05, 3.5),
    "Cyrillic": (1.0, 8.0, 0.10, 3.0),
    "Greek": (0.7, 6.0, 0.20, 2.5),
    "Han": (0.4, 3.0, 0.60, 3.0),
    "Hiragana": (0.4, 3.0, 0.40, 2.5),
    "Katakana": (0.4, 3.0, 0.40, 2.5),
    "other": (0.2, 8.0, 1.0, 2.0),
    # measured with piece_bpe_32k on sentences of the Declaration of Human Rights:
    # characters per token 1.15, 0.99, 1.18, byte fallback 0.02, 0.14, 0.13
    "vi/Latin": (0.9, 8.0, 0.10, 3.5),
    "yo/Latin": (0.75, 8.0, 0.30, 3.5),
    "fon/Latin": (0.9, 8.0, 0.30, 3.5),
}
SHORT = 0.5

#: Robust deviations from the median of a language's class: characters per token below and above, entropy below, byte fallback above.
WIDTHS = (6.0, 12.0, 3.5, 12.0)
#: Byte fallback that is allowed above a language's median in any case.
BYTES = 0.05

#: Least robust deviations times the root of the token count: of characters per token as a share of their median, of entropy in bits.
FLOORS = (0.3, 2.0)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, chars_per_token double, byte_share double, token_entropy double, n_tokens long"
_WIDE = re.compile("[ɐ-\U0010ffff]")
_LATIN = regex.compile(r"\p{Latin}")
_OTHERS = [(s, regex.compile(rf"\p{{{s}}}")) for s in SCRIPTS]
_LETTER = regex.compile(r"\p{L}")


def script_of(text: str) -> str:
    """The script of most letters; Latin where only Latin-1 and its extensions occur, other without letters of a known script."""
    if not _WIDE.search(text):
        return "Latin" if text.isascii() or _LETTER.search(text) else "other"
    counts = {"Latin": len(_LATIN.findall(text))} | {s: len(p.findall(text)) for s, p in _OTHERS}
    best = max(counts, key=counts.get)
    return best if counts[best] * 2 >= len(_LETTER.findall(text)) and counts[best] else "other"


def repeat_words(words: list[str], width: int = 5) -> int:
    """Words in windows of `width` words that occur twice or more; all their places count."""
    windows = list(zip(*(words[k:] for k in range(width))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total = covered = 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + width - max(covered, at)
            covered = at + width
    return total


def base_counts(text: str | None) -> tuple:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in lines:
                dup += 1
            elif WORD.search(line):
                lines.add(line)
    again = repeat_words(words)
    return words, (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, again, n < 10 or 100 * again > 20 * n)


class PieceMeter:
    """Fertility of lists of words under a SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.words = Memo(lambda w: np.array(self.model.encode(w), np.uint16).tobytes())

    def measure(self, words: list[str]) -> tuple[int, float, float]:
        """Tokens, byte-fallback share, entropy in bits."""
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.uint16)
        if not len(ids):
            return 0, 0.0, 0.0
        kinds, counts = np.unique(ids, return_counts=True)
        share = counts / len(ids)
        return len(ids), float(counts[self.is_byte[kinds]].sum() / len(ids)), float(-(share * np.log2(share)).sum()) + 0.0


def _measured(docs: DataFrame, path: str) -> DataFrame:
    """docs with a struct __vf_fertility and the digest of the text."""
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in MEASURES.split(", "))])

    def start():
        meter = PieceMeter(path)

        def measure(text):
            words, base = base_counts(text)
            n, byte_share, entropy = meter.measure(words)
            return (*base, *((script_of(text), base[1] / n, byte_share, entropy) if n else (None,) * 4), n)

        return measure

    return docs.withColumn("__vf_digest", F.xxhash64("text")).withColumn("__vf_fertility", text_map(start, schema, "text"))


def _limits(keyed: DataFrame, f: dict, least: int) -> DataFrame:
    """For each (group, class, script) of the table the quartiles of the finest of its classes with `least` distinct texts.

    Levels: 0 the language's size class, 1 with the neighbouring sizes, 2 the whole language, 3 the whole script."""
    whole = F.lit(-1)
    place = lambda level, group, size: F.struct(F.lit(level).alias("level"), group.alias("group"), size.alias("size"))
    group, size, script = F.col("__vf_group"), F.col("__vf_class"), F.col("__vf_script")
    near = [place(1, group, size + k) for k in (-1, 0, 1)]
    measures = keyed.where(~f["base_failed"] & (f["n_tokens"] > 0)).select(
        "__vf_group", "__vf_class", "__vf_script", "__vf_digest",
        f["chars_per_token"].alias("c"), f["token_entropy"].alias("e"), f["byte_share"].alias("b"), (F.log2(f["n_tokens"]) - f["token_entropy"]).alias("d"),
    ).distinct()  # copies of a text count once
    exploded = measures.select(F.explode(F.array(place(0, group, size), *near, place(2, group, whole), place(3, script, whole))).alias("at"), "c", "e", "b", "d")
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(x) for x in "cebd"]
    middle = exploded.groupBy("at.level", "at.group", "at.size").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= least)
    wanted = keyed.where(size.isNotNull()).select("__vf_group", "__vf_class", "__vf_script").distinct()
    wanted = wanted.select("*", F.explode(F.array(place(0, group, size), place(1, group, size), place(2, group, whole), place(3, script, whole))).alias("at"))
    wanted = wanted.select(group.alias("__vf_g"), size.alias("__vf_k"), script.alias("__vf_s"), "at.*")
    found = wanted.join(middle, ["level", "group", "size"])
    return found.groupBy("__vf_g", "__vf_k", "__vf_s").agg(F.min_by(F.struct("level", "c", "e", "b", "d"), "level").alias("__vf_of")).select("__vf_g", "__vf_k", "__vf_s", "__vf_of.*")


def _judged(measured: DataFrame, language: str, bands: dict, widths: tuple, least: int) -> DataFrame:
    """measured with __vf_kept."""
    f = {k: F.col(f"__vf_fertility.{k}") for k in ("script", "chars_per_token", "byte_share", "token_entropy", "n_tokens", "base_failed")}
    spoken = F.col(language) if language in measured.columns else F.lit(None).cast("string")
    keyed = measured.withColumn("__vf_group", F.coalesce(spoken, f["script"])).withColumn("__vf_script", f["script"])
    keyed = keyed.withColumn("__vf_class", F.when(f["n_tokens"] > 0, F.floor(F.log2(f["n_tokens"])).cast("int")))
    tokens = F.sqrt(F.pow(F.lit(2.0), F.col("__vf_k")))
    floor = {"c": F.lit(FLOORS[0]) * F.col("c")[1] / tokens, "e": F.lit(FLOORS[1]) / tokens, "d": F.lit(FLOORS[1]) / tokens, "b": F.lit(0.0)}
    below = lambda x: F.greatest((F.col(x)[1] - F.col(x)[0]) / 0.6745, floor[x])
    above = lambda x: F.greatest((F.col(x)[2] - F.col(x)[1]) / 0.6745, floor[x])
    limits = _limits(keyed, f, least).select(
        "__vf_g", "__vf_k", "__vf_s", F.col("level").alias("__vf_level"),
        (F.col("c")[1] - widths[0] * below("c")).alias("__vf_low"), (F.col("c")[1] + widths[1] * below("c")).alias("__vf_high"),
        (F.col("b")[1] + F.greatest(widths[3] * above("b"), F.lit(BYTES))).alias("__vf_bytes"),
        (F.col("e")[1] - widths[2] * below("e")).alias("__vf_least"), (F.col("d")[1] + widths[2] * above("d")).alias("__vf_lack"),
    )
    fixed = F.create_map(*(x for k, v in bands.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    tag = F.concat(F.lower(F.regexp_extract(spoken, "^[A-Za-z]+", 0)), F.lit("/"), f["script"])
    band = F.coalesce(fixed[F.coalesce(tag, f["script"])], fixed[f["script"]], fixed["other"])
    most = F.log2(f["n_tokens"])
    c, b, e = f["chars_per_token"], f["byte_share"], f["token_entropy"]
    own = F.col("__vf_level") <= 2
    # entropy grows with the length of a text, and so does what it lacks to the most: outside its own size class a text may stay below one of both
    enough = F.when(F.col("__vf_level") == 0, e >= F.col("__vf_least")).otherwise((e >= F.col("__vf_least")) | (most - e <= F.col("__vf_lack")))
    inside = F.when(own, c.between(F.col("__vf_low"), F.col("__vf_high")) & (b <= F.col("__vf_bytes"))).otherwise(c.between(band[0], band[1]) & (b <= band[2]))
    usual = F.coalesce(enough, F.lit(True)) & (own.eqNullSafe(F.lit(True)) | (e >= F.least(band[3], F.lit(SHORT) * most)))
    joined = keyed.join(small_side(limits, "bands"), (F.col("__vf_group") == F.col("__vf_g")) & (F.col("__vf_class") == F.col("__vf_k")) & (F.col("__vf_script") == F.col("__vf_s")), "left")
    return joined.withColumn("__vf_kept", F.coalesce(~f["base_failed"] & inside & usual, F.lit(False)))


def rate(docs: DataFrame, path: str, language: str = "lang", bands: dict | None = None, widths: tuple = WIDTHS, least: int = 100) -> DataFrame:
    """One row per document: the base counts, the measures, and whether it is kept."""
    columns = [c for c in ("doc_id", language) if c in docs.columns]
    measured = stash(_measured(docs.select(*columns, "text"), path).drop("text"), "fertility")
    judged = _judged(measured, language, bands or BANDS, widths, least)
    return judged.select("doc_id", "__vf_fertility.*", F.col("__vf_kept").alias("kept"))


def keep(docs: DataFrame, path: str, language: str = "lang", bands: dict | None = None, widths: tuple = WIDTHS, least: int = 100) -> DataFrame:
    """The documents that are kept, with their columns as they were; texts are written once and not shuffled."""
    return _judged(stash(_measured(docs, path), "fertility"), language, bands or BANDS, widths, least).where("__vf_kept").select(*docs.columns)
