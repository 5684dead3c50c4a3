"""Language identification: nearest of several TF-IDF n-gram centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.common import sliced

# At most so many labelled rows, spread evenly over the languages, fit the centroids.
FIT_ROWS = 2000
FEATURES = 8192
CENTROIDS = 4
# A text is rejected under so much of what nearly all texts of its language reach: short
# texts of a known language with a foreign line in them come to a third, other languages
# without common words to a quarter at most.
SLACK = 0.3
# Texts of one length, a power of 2 of n-grams, say what is usual if there are so many.
FEWEST_OF_LENGTH = 5
UNKNOWN = "und"

# Texts are read in slices of so many characters; slices overlap by a trigram's worth.
SLICE = 1 << 20


def _letter_table() -> np.ndarray:
    """Code point to lower-case letter, and 0 for what is no letter."""
    codes = np.arange(0x3000, dtype=np.uint32)
    out = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 0 for c in map(chr, codes.tolist())]
    return np.asarray(out, dtype=np.uint32)


LETTERS = _letter_table()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the bigrams and trigrams of the words of a whole text.

    Everything that is no letter is one space; an n-gram may begin or end with it.
    """
    counts = np.zeros(FEATURES, dtype=np.int64)
    tail = np.zeros(1, dtype=np.uint32)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = np.where(codes < len(LETTERS), LETTERS[np.minimum(codes, len(LETTERS) - 1)], codes)
        end = np.zeros(int(at + SLICE >= len(text)), dtype=np.uint32)
        run = np.concatenate([tail, letters, end])
        run = run[np.append(True, (run[1:] != 0) | (run[:-1] != 0))]
        # What lies in the tail alone was counted before.
        pair = (run[:-1] * np.uint32(0x9E3779B1)) ^ (run[1:] * np.uint32(0x85EBCA77))
        three = (pair[:-1] * np.uint32(0x27D4EB2F) ^ (run[2:] * np.uint32(0xC2B2AE3D)))[run[1:-1] != 0]
        found = np.concatenate([pair[len(tail) - 1 :] * np.uint32(0x165667B1), three * np.uint32(0x2545F491)])
        counts += np.bincount((found ^ (found >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(19), minlength=FEATURES)
        tail = run[-2:]
    return counts


def packed(counts: np.ndarray) -> bytes:
    """The features that occur, and how often."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    counts = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, row in enumerate(rows):
        n = len(row) // 6
        counts[i, np.frombuffer(row, dtype="<u2", count=n)] = np.frombuffer(row, dtype="<u4", offset=2 * n)
    return counts


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Centroids:
    """What ``fit`` learned; a few hundred KB."""

    languages: list[str]
    owner: np.ndarray  # language of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    # The usual cosine of a text of so many n-grams: logarithms to base 2, and cosines.
    lengths: np.ndarray
    usual: np.ndarray
    least: np.ndarray  # per language, the share of the usual cosine under which a text is rejected

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Turn counts (float32) into unit TF-IDF vectors where they stand."""
        np.log1p(counts, out=counts)
        counts *= self.idf
        counts /= np.maximum(np.sqrt(np.einsum("ij,ij->i", counts, counts)), 1e-12)[:, None]
        return counts

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and cosine of the nearest centroid of each unit vector."""
        cosines = vectors @ self.vectors.T
        best = cosines.argmax(axis=1)
        return self.owner[best], np.clip(cosines[np.arange(len(best)), best], 0, 1)

    def share(self, cosine: np.ndarray, n_grams: np.ndarray) -> np.ndarray:
        """Cosines as shares of what is usual for texts of so many distinct n-grams.

        Short texts are further from any centroid than long ones. Below the
        shortest length known the usual cosine falls with the root of the length.
        """
        at = np.log2(np.maximum(n_grams, 1))
        if not len(self.lengths):
            return np.ones_like(cosine)
        below = np.exp2(np.minimum(at - self.lengths[0], 0) / 2)
        return cosine / np.maximum(np.interp(at, self.lengths, self.usual) * below, 1e-12)


def _cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from far-apart seeds: at most ``k`` unit centroids."""
    seeds = [vectors[(vectors @ vectors.mean(axis=0)).argmax()]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(vectors[np.max(vectors @ np.stack(seeds).T, axis=1).argmin()])
    centres = np.stack(seeds)
    for _ in range(rounds):
        owner = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[owner == i].sum(axis=0) if (owner == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


COUNTS = "lang string, counts binary"


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, slack: float = SLACK) -> Centroids | None:
    """Learn centroids from the labelled rows of ``docs`` outside the held-out fold.

    Uses ``fit_rows`` rows at most, the same number of each language where it has
    that many, chosen by a hash of the id (rows without one share it). Four
    fifths make the inverse document frequencies and centroids. The rest is held
    back for the limits: the median cosine of each length, and per language
    ``slack`` times the share of it that all but one in 200 of its texts reach.
    A language of which nothing is held back rejects nothing. Texts without
    letters teach nothing. None if there is nothing to learn from.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", "doc_id")
    per_language = labelled.groupBy("lang").count()
    share = per_language.withColumn("share", F.lit(fit_rows) / F.count(F.lit(1)).over(Window.partitionBy()) / F.col("count")).select("lang", "share")
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_003)) / 1_000_003
    chosen = labelled.join(F.broadcast(share.orderBy("lang").limit(fit_rows)), "lang").filter(draw < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(lang, t) for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and has_letter(t)]
            counts = [packed(ngram_counts(t)) for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in rows], pa.string()), pa.array(counts, pa.binary())], names=["lang", "counts"]
            )

    sample = chosen.orderBy(draw, "lang").limit(fit_rows).select("lang", "text").mapInArrow(count, COUNTS).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    languages = sorted({r["lang"] for r in sample})
    owner = np.asarray([languages.index(r["lang"]) for r in sample])
    counts = unpacked([bytes(r["counts"]) for r in sample])
    for_limits = np.arange(len(sample)) % 5 == 4
    idf = np.log((1 + len(sample)) / (1 + (counts[~for_limits] > 0).sum(axis=0))).astype(np.float32)
    none = np.zeros(0)
    model = Centroids(languages, none.astype(int), np.zeros((0, FEATURES), np.float32), idf, none, none, np.zeros(len(languages)))
    n_grams = (counts > 0).sum(axis=1)
    vectors = model.weigh(counts)
    made = [_cluster(vectors[(owner == i) & ~for_limits] if ((owner == i) & ~for_limits).any() else vectors[owner == i], centroids) for i in range(len(languages))]
    model.vectors = np.concatenate(made).astype(np.float32)
    model.owner = np.repeat(np.arange(len(languages)), [len(m) for m in made])
    found, cosine = model.nearest(vectors)
    right = for_limits & (found == owner)
    length = np.floor(np.log2(np.maximum(n_grams, 1)))
    alike = [right & (length == x) for x in np.unique(length[right])]
    alike = [rows for rows in alike if rows.sum() >= FEWEST_OF_LENGTH] or ([right] if right.any() else [])
    model.lengths = np.asarray([np.median(np.log2(n_grams[rows])) for rows in alike])
    model.usual = np.asarray([np.median(cosine[rows]) for rows in alike])
    share = model.share(cosine, n_grams)
    for i in range(len(languages)):
        own = share[right & (owner == i)]
        model.least[i] = slack * np.quantile(own, 0.005) if len(own) else 0.0
    return model


def identify(docs: DataFrame, model: Centroids | None, keep: tuple[str, ...] = ("*",), rows_at_once: int = 256) -> DataFrame:
    """The columns ``keep`` of ``docs`` in a struct ``doc``, and lang_pred, score, rejected.

    Reads whole texts, and of a row nothing but its text. ``lang_pred`` is the
    language of the nearest centroid and ``score`` its cosine. A text that is
    null or has no letter, or any if nothing was learned, is ``und`` with 0.
    Of centroids at the same cosine the first counts, languages in code-point
    order. ``rejected``: ``und``, or further from its centroid than the
    language's limit for texts of that length. Texts are read whole, however
    long, and other columns kept as they are, whatever their names. Equal texts
    get equal answers; an empty table gives no rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, scores, out = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if t and model is not None and has_letter(t)]
            for at in range(0, len(known), rows_at_once):
                part = known[at : at + rows_at_once]
                counts = np.stack([ngram_counts(texts[i]) for i in part]).astype(np.float32)
                n_grams = (counts > 0).sum(axis=1)
                found, cosine = model.nearest(model.weigh(counts))
                far = model.share(cosine, n_grams) < model.least[found]
                for i, language, score, is_far in zip(part, found.tolist(), cosine.tolist(), far.tolist(), strict=True):
                    names[i], scores[i], out[i] = model.languages[language], score, is_far
            answer = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *answer], names=["doc", "lang_pred", "score", "rejected"])

    whole = docs.select(F.struct(*keep).alias("doc"), "text")
    schema = whole.select("doc").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return whole.mapInArrow(predict, schema)
