"""Quality rules as weak supervision.

Each rule votes good, bad or abstains.  Rows with equal votes are counted (at most 3 to the
power of the number of rules patterns, whatever the input), expectation-maximisation over the
counted patterns estimates how often each rule is right and how often it abstains, and each
document gets the posterior probability that it is good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, documents_of, materialize, over_texts

#: The symbols counted by the base rules.
SYMBOLS = b"#*$%&|<>"
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, n_distinct long, n_digits long, n_upper long, n_marks long, n_plain_words long, n_ended_lines long, n_filled_lines long"
#: ASCII characters that are neither letters, digits nor white space; a plain word: letters, with quotes, brackets and stops around them; how a sentence ends.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
PLAIN_WORD = r"^[\"'(\[«¿¡]*\p{L}[\p{L}\p{M}'’-]*[.,;:!?…\"')\]»]*$"
ENDED_LINE = r"[.!?…:;。！？][\"')\]»]*\s*$"


def byte_counts(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """How many bytes of each text are among ``wanted``."""
    flags = np.zeros(256, np.int64)
    flags[list(wanted)] = 1
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    seen = np.concatenate([[0], np.cumsum(flags[data])])
    return np.diff(seen[offsets - offsets[0]])


def repeated(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each element, how often its key occurs in its owner, and whether it is the first there."""
    _, dense = np.unique(keys, return_inverse=True)
    _, first, back, count = np.unique((owners.astype(np.int64) << 32) | dense, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return count[back], is_first


def per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[starts[1:]] - total[starts[:-1]]


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text, all exact; see ``STATS``."""
    texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
    words = Words(texts, lower=False)
    starts, lengths, owners = words.starts, words.lengths, words.owners()
    codes, n = words.codes.astype(np.int64), max(1, len(words.uniques))
    sizes = pc.utf8_length(words.uniques).to_numpy()[words.codes] if len(codes) else np.zeros(0, np.int64)
    covered = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        _, pairs = np.unique(codes[:-1] * n + codes[1:], return_inverse=True)
        keys, at = pairs[:-1] * n + codes[2:], np.flatnonzero(owners[2:] == owners[:-2])
        many = at[repeated(keys[at], owners[at])[0] > 1]
        for k in range(3):
            covered[many + k] = True
    distinct = repeated(codes, owners)[1] if len(codes) else covered
    split = pc.split_pattern(texts, "\n")
    lines, line_starts = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
    line_starts = line_starts - line_starts[0]
    line_owner = np.repeat(np.arange(len(texts)), np.diff(line_starts))
    line_codes = lines.indices.to_numpy()
    ended = pc.match_substring_regex(lines.dictionary, ENDED_LINE).to_numpy(zero_copy_only=False)[line_codes]
    plain = pc.match_substring_regex(words.uniques, PLAIN_WORD).to_numpy(zero_copy_only=False)[words.codes] if len(codes) else covered
    has_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines.dictionary)), 0).to_numpy(zero_copy_only=False)[line_codes]
    again = ~repeated(line_codes, line_owner)[1] & has_word
    return {
        "n_words": lengths, "word_chars": per_text(sizes, starts), "n_symbols": byte_counts(texts, SYMBOLS), "n_dup_lines": per_text(again, line_starts),
        "n_repeat_words": per_text(covered, starts), "n_chars": pc.utf8_length(texts).to_numpy(), "n_lines": np.diff(line_starts), "n_distinct": per_text(distinct, starts),
        "n_digits": byte_counts(texts, b"0123456789"), "n_upper": byte_counts(texts, bytes(range(65, 91))),
        "n_marks": byte_counts(texts, MARKS), "n_plain_words": per_text(plain, starts), "n_ended_lines": per_text(ended & has_word, line_starts), "n_filled_lines": per_text(has_word, line_starts),
    }


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of counts (``STATS``) for each row of documents; a null or empty text has zeros, and one line."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = text_stats(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in stats.values())], names=["doc_id", *stats])

    return over_texts(documents_of(docs), work, STATS)


def rules() -> dict[str, tuple[Column, Column]]:
    """Name: (votes good, votes bad); neither means that the rule abstains."""
    words, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    mean = c("word_chars") / words
    symbol, dup, again = c("n_symbols") / F.greatest(c("n_chars"), F.lit(1)), c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), c("n_repeat_words") / words
    rich, digit, upper, per_line = c("n_distinct") / words, c("n_digits") / F.greatest(c("n_chars"), F.lit(1)), c("n_upper") / F.greatest(c("word_chars"), F.lit(1)), words / F.greatest(c("n_lines"), F.lit(1))
    marks, plain, ended = c("n_marks") / F.greatest(c("n_chars"), F.lit(1)), c("n_plain_words") / words, c("n_ended_lines") / F.greatest(c("n_filled_lines"), F.lit(1))
    return {
        "length": (c("n_words") >= 80, c("n_words") < 30),
        "word_size": ((mean >= 3) & (mean <= 10), (mean < 2) | (mean > 15)),
        "symbols": (symbol < 0.01, symbol > 0.04),
        "line_repeats": (dup < 0.1, dup > 0.3),
        "phrase_repeats": (again < 0.1, again > 0.3),
        "vocabulary": (rich >= 0.3, rich < 0.15),
        "digits": (digit < 0.1, digit > 0.25),
        "capitals": (upper < 0.2, upper > 0.5),
        "line_size": (per_line >= 5, per_line < 2),
        "marks": (marks < 0.06, marks > 0.08),
        "plain_words": (plain >= 0.85, plain < 0.6),
        "line_ends": (ended >= 0.95, ended < 0.9),
    }


def fit_votes(patterns: list[tuple[str, int]], steps: int = 60) -> dict[str, float]:
    """Posterior of "good" for each pattern of votes ('g', 'b', '-' a rule), by expectation-maximisation.

    The model: a class, then for each rule, independently, good, bad or abstaining with
    chances of the class.  A vote may never speak against its own name (bounded odds), so the
    classes keep their meaning.  No patterns: no posteriors.
    """
    if not patterns:
        return {}
    votes = np.array([["gb-".index(x) for x in p] for p, _ in patterns])
    counts = np.array([n for _, n in patterns], float)
    rules = votes.shape[1]
    # class (good, bad), rule, vote: to begin with, a bad document has a few faults, and most rules find nothing wrong
    chance = np.tile(np.array([[[0.85, 0.02, 0.13]], [[0.6, 0.25, 0.15]]]), (1, rules, 1))
    prior = np.array([0.8, 0.2])
    for _ in range(steps):
        logs = np.log(prior)[:, None] + np.log(chance)[:, np.arange(rules), votes].sum(2)
        post = np.exp(logs - logs.max(0))
        post /= post.sum(0)
        share = post * counts
        prior = (share.sum(1) + 1) / (share.sum() + 2)
        for v in range(3):
            chance[:, :, v] = np.stack([(share * (votes[:, r] == v)).sum(1) for r in range(rules)], 1)
        chance = (chance + 0.5) / (chance + 0.5).sum(2, keepdims=True)
        # a good vote is at least as likely for good documents, a bad vote for bad ones
        for v, less, more in ((0, 1, 0), (1, 0, 1)):
            wrong = chance[less, :, v] > chance[more, :, v]
            level = (chance[less, :, v] + chance[more, :, v]) / 2
            chance[less, :, v] = np.where(wrong, level, chance[less, :, v])
            chance[more, :, v] = np.where(wrong, level, chance[more, :, v])
        chance /= chance.sum(2, keepdims=True)
    return {p: float(x) for (p, _), x in zip(patterns, post[0], strict=True)}


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, base verdict, votes, posterior and verdict of each row of documents.

    base_failed: under 50 words, or over half of the words in 3-word windows that occur twice
    or more in the text.  kept: not base_failed and posterior >= threshold.  Null or empty
    texts fail the base rules.  Every row is judged alone, so repeated rows agree, and a null
    doc_id changes nothing.  An empty table gives no rows.
    """
    stats = document_stats(docs)
    vote = F.concat(*(F.when(good, "g").when(bad, "b").otherwise("-") for good, bad in rules().values()))
    stats = materialize(stats.withColumn("votes", vote), "votes")
    patterns = [(r.votes, r["count"]) for r in stats.groupBy("votes").count().orderBy("votes").collect()]  # bounded: 3 ** rules
    posterior = fit_votes(patterns)
    judged = stats.join(F.broadcast(docs.sparkSession.createDataFrame(list(posterior.items()), "votes string, posterior double")), "votes")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior", "votes",
    )
