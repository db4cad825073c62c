"""Languages of a text as a mixture: expectation-maximisation over word likelihoods, with a penalised choice of the set."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.llm._scratch import release
from idloom.llm._text import BLOCK, _cuts, blocks, buffers, segment_sum, word_spans

BUCKET_BITS, PER_LANGUAGE, LANGUAGES, PENALTY, MIN_SHARE = 17, 600, 128, 6.0, 0.05
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


@dataclass(frozen=True)
class LanguageModel:
    """log_p: a row per hashed trigram of bytes, a column per language; the last column is `und`, the uniform distribution."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def _trigrams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter byte its bucket, of itself and both neighbours, and its position.

    All else counts as a gap, and so does a whole run of letters and digits that holds a digit: keys, hashes, numbers.
    """
    cur = _LETTER[raw].astype(np.uint32)
    digit = (raw >= 48) & (raw <= 57)
    if digit.any():
        begin, end = word_spans(raw, starts)
        seen = np.concatenate([[0], np.cumsum(digit)])
        coded = seen[end] > seen[begin]
        change = np.zeros(len(raw) + 1, np.int32)
        np.add.at(change, begin[coded], 1)
        np.add.at(change, end[coded], -1)
        cur[np.cumsum(change[:-1]) > 0] = 0
    left, right = np.zeros_like(cur), np.zeros_like(cur)
    left[1:], right[:-1] = cur[:-1], cur[1:]
    begins = starts[starts < len(raw)]
    left[begins] = 0
    right[begins[begins > 0] - 1] = 0
    at = np.flatnonzero(cur)
    code = (left[at] << np.uint32(16)) | (cur[at] << np.uint32(8)) | right[at]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), at


def _words(part: np.ndarray, starts: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of the words of consecutive texts, and where each word begins."""
    code, at = _trigrams(part, starts)
    if not len(at):
        return np.zeros((0, model.log_p.shape[1]), np.float32), at
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = at[1:] != at[:-1] + 1
    doc = np.searchsorted(at, starts)
    fresh[doc[doc < len(at)]] = True
    first = np.flatnonzero(fresh)
    return np.add.reduceat(model.log_p[code], first, axis=0), at[first]


def word_likelihoods(texts: pa.Array, model: LanguageModel):
    """For each block of rows: (i, j, log-likelihoods of the words by language, offsets of the words by row).

    A text longer than a block comes alone, its likelihoods in a list of parts of single precision.
    """
    raw, offsets = buffers(pc.utf8_lower(texts))
    for i, j in blocks(offsets):
        part, starts = raw[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
        if len(part) > BLOCK:
            cuts = _cuts(part)
            yield i, j, [_words(part[a:b], np.zeros(1, np.int64), model)[0] for a, b in zip(cuts, cuts[1:])], None
            continue
        likely, begins = _words(part, starts, model)
        yield i, j, likely.astype(np.float64), np.searchsorted(begins, offsets[i : j + 1] - offsets[i]).astype(np.int64)


def infer_long(parts: list[np.ndarray], penalty: float = PENALTY, min_share: float = MIN_SHARE, rounds: int = 12) -> tuple[np.ndarray, int]:
    """(proportions, words) of one text given in parts, as infer has them; no table of the whole text is made."""
    n, k = sum(map(len, parts)), parts[0].shape[1]
    single = sum(p.sum(axis=0, dtype=np.float64) for p in parts)
    out = np.zeros(k)
    if not n:
        return out, 0
    out[single.argmax()] = 1
    price, value = penalty * np.log(max(n, 2)), single.max()
    if n < 2 or sum(p.max(axis=1).sum(dtype=np.float64) for p in parts) - price <= value:
        return out, n

    def mixture(allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        pi = allowed / allowed.sum()
        for last in [False] * rounds + [True]:
            joint, reach = np.zeros(k), 0.0
            for part in parts:
                top = part.max(axis=1, keepdims=True).astype(np.float64)
                p = np.exp(part - top) * pi
                total = np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
                if last:
                    reach += float((np.log(total) + top).sum())
                else:
                    joint += (p / total).sum(axis=0)
            if last:
                return pi, reach
            pi = joint / n

    full, _ = mixture(np.ones(k), rounds)
    order, value = np.argsort(-full, kind="stable"), value - price
    for m in range(2, k + 1):
        allowed = np.zeros(k)
        allowed[order[:m]] = 1
        pi, got = mixture(allowed, 2 * rounds)
        if got - m * price > value and pi[order[:m]].min() >= min_share:
            value, out = got - m * price, pi
    return out, n


def _mixture(likely: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: the proportions of the allowed languages and the log-likelihood that they reach."""
    counts = np.diff(offsets)
    top = likely.max(axis=1)
    p = np.exp(likely - top[:, None])
    doc = np.repeat(np.arange(len(counts)), counts)
    pi = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        joint = p * pi[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        pi = segment_sum(joint, offsets) / np.maximum(counts, 1)[:, None]
    return pi, segment_sum(np.log(np.maximum((p * pi[doc]).sum(axis=1), 1e-300)) + top, offsets)


def infer(likely: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY, min_share: float = MIN_SHARE, rounds: int = 12) -> np.ndarray:
    """Proportions by document, 0 for the languages outside its chosen set.

    The sets compared are the m most common languages of the full mixture, m from 1 up, each fitted again by itself; the
    choice has the largest log-likelihood - penalty * m * ln(words).  A set with a language under `min_share` isn't chosen.
    Ties go to the smaller set, then to the first language by name.  Documents without words have proportions of 0.
    """
    counts, k = np.diff(offsets), likely.shape[1]
    single = segment_sum(likely, offsets)
    best, out = single.argmax(axis=1), np.zeros((len(counts), k))
    has = np.flatnonzero(counts)
    out[has, best[has]] = 1
    if not len(has):
        return out
    price = penalty * np.log(np.maximum(counts, 2))
    # No mixture reaches more than each word under its own best language: most documents need no EM.
    ceiling = segment_sum(likely.max(axis=1), offsets)
    doubt = np.flatnonzero((counts > 1) & (ceiling - price > single.max(axis=1)))
    if not len(doubt):
        return out
    take = np.repeat(np.isin(np.arange(len(counts)), doubt), counts)
    likely, single, price = likely[take], single[doubt], price[doubt]
    offsets = np.concatenate([[0], np.cumsum(counts[doubt])])
    full, reach = _mixture(likely, offsets, np.ones((len(doubt), k)), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    value = single.max(axis=1) - price
    # EM's value after these rounds lies below the maximum; the gap has this bound, as the log-likelihood is concave.
    doc = np.repeat(np.arange(len(doubt)), np.diff(offsets))
    p = np.exp(likely - likely.max(axis=1, keepdims=True))
    ratio = segment_sum(p / np.maximum((p * full[doc]).sum(axis=1, keepdims=True), 1e-300), offsets) / np.diff(offsets)[:, None]
    bound = reach + np.diff(offsets) * np.log(np.maximum(ratio.max(axis=1), 1))
    open_ = np.flatnonzero(bound - 2 * price > value)
    for m in range(2, k + 1):
        if not len(open_):
            break
        take = np.isin(doc, open_)
        part = np.concatenate([[0], np.cumsum(np.diff(offsets)[open_])])
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :m], 1, axis=1)
        pi, got = _mixture(likely[take], part, allowed, 2 * rounds)
        got = got - m * price[open_]
        wins = (got > value[open_]) & (np.where(allowed > 0, pi, 1).min(axis=1) >= min_share)
        won = open_[wins]
        value[won], out[doubt[won]] = got[wins], pi[wins]
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, smoothing: float = 0.2, languages: int = LANGUAGES) -> LanguageModel:
    """Train on at most about `per_language` whole labelled texts of each of the `languages` commonest labels.

    Texts are chosen by hash, and copies of a text count once.  These bounds are the sample's only ones.  Rows with a null text
    or label don't count.  Without labelled rows the model has `und` alone.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    languages = tuple(sorted(counts))
    if languages:
        rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
        chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < rate[F.col("lang")] * F.lit(float(1 << 30))
        rows = known.where(chosen).distinct().toArrow()
    size = 1 << BUCKET_BITS
    log_p = np.full((size, len(languages) + 1), -np.log(size), np.float32)
    for k, lang in enumerate(languages):
        texts = rows.column("text").filter(pc.equal(rows.column("lang"), lang)).combine_chunks()
        raw, offsets = buffers(pc.utf8_lower(texts))
        seen = np.zeros(size)
        for i, j in blocks(offsets):
            code, _ = _trigrams(raw[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
            seen += np.bincount(code, minlength=size)
        log_p[:, k] = np.log((seen + smoothing) / (seen.sum() + smoothing * size))
    rows = None
    release()
    return LanguageModel((*languages, UNKNOWN), log_p)


RESULT = "struct<languages:array<string>,shares:array<double>,accepted:boolean>"


def language_mixture(docs: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = PENALTY, min_share: float = MIN_SHARE) -> Column:
    """Column struct<languages, shares, accepted>: the chosen languages by falling share, rounded to 4 places.

    A document is accepted if `und`, text that fits no language better than chance, has at most half of its words.  Null
    texts and texts without letters have no languages and aren't accepted.  Texts are read whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def identify(texts: pa.Array) -> pa.Array:
        model = shared.value
        names, und = np.array(model.languages, dtype=object), len(model.languages) - 1
        sizes, langs, shares, accepted = [], [], [], []
        for _, _, likely, offsets in word_likelihoods(texts, model):
            if offsets is None:
                pi, n = infer_long(likely, penalty, min_share)
                pi, offsets = pi[None], np.array([0, n])
            else:
                pi = infer(likely, offsets, penalty, min_share)
            order = np.argsort(-pi, axis=1, kind="stable")
            ranked = np.take_along_axis(pi, order, axis=1)
            keep = ranked > 0
            sizes.append(keep.sum(axis=1))
            langs.append(order[keep])
            shares.append(ranked[keep])
            accepted.append((np.diff(offsets) > 0) & (pi[:, und] <= 0.5))
        at = pa.array(np.concatenate([[0], *sizes]).cumsum().astype(np.int32))
        flat = lambda x: np.concatenate(x) if x else np.zeros(0)
        names_flat = pa.array(names[flat(langs).astype(np.int64)], pa.string())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(at, names_flat), pa.ListArray.from_arrays(at, pa.array(np.round(flat(shares), 4), pa.float64())), pa.array(flat(accepted).astype(bool), pa.bool_())],
            ["languages", "shares", "accepted"],
        )

    return identify(F.col(text_col))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, language, languages, shares, accepted) for every row; language is the first, or null.  Other columns are left out.

    Rows keep null and repeated ids; an empty table gives no rows.
    """
    model = fit(docs, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), language_mixture(docs, model, text_col, **how).alias("r"))
    return found.select("doc_id", F.try_element_at("r.languages", F.lit(1)).alias("language"), "r.languages", "r.shares", "r.accepted")


def accept_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The accepted rows with all their columns as they are."""
    return docs.where(language_mixture(docs, fit(docs, text_col, lang_col), text_col, **how)["accepted"])
