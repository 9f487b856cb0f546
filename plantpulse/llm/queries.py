"""The registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprints, jaccard, lexical, licenses, packing, quality, repetition, spelling, token_counts, toxicity, urls
from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PACKING_TOKENIZER = "byte_bpe_50k.json"
COUNTING_TOKENIZER = "piece_bpe_32k.model"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_ordinal_quality(spark, folder):
    """Expected grade (0 to 2), P(grade > 0) and the decision of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, quality.grades_of(labels))
    judged = quality.judged(docs.select("doc_id", "text"), model)
    tail = F.col("quality.tails")
    return judged.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality.expected").alias("expected_grade"),
        F.get(tail, F.lit(0)).alias("p_above_0"),
        F.get(tail, F.lit(1)).alias("p_above_1"),
        (F.get(tail, F.lit(0)) >= 0.5).alias("keep"),
    )


@query
def op2_decontamination(spark, folder):
    found = decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op2_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, l, array_to_string(w[i:i + l - 1], ' ') AS s
        FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM n)),
runs AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
         FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, l, item FROM runs JOIN win USING (l, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op3_best_fit_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


@query
def op4_url_rules(spark, folder):
    """A page outside the held-out fold is labelled by what its whole html shows; the rules are mined on these labels."""
    pages = table(spark, folder, "pages")
    given = pages.where(~held_out("page_id")).select("url", urls.shows_spam(F.col("html")).alias("blocked"))
    rules = urls.mine(given)
    return urls.judge(pages, rules)


@query
def op5_license_scan(spark, folder):
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.withColumn("expressions", F.array_join("expressions", "; "))


@query
def op6_fingerprints(spark, folder):
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


@query
def op7_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    lexicon = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score_column(docs, lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op8_jaccard_join(spark, folder):
    return jaccard.join_components(table(spark, folder, "documents"))


@query
def op9_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(COUNTING_TOKENIZER))


@query
def op10_chat_format(spark, folder):
    """All conversations and one more, -1, whose texts hold the control strings of a common template."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_conversations(given.unionByName(extra)))
    return read.withColumnRenamed("conv", "conv_id")


@query
def op11_quality_rules(spark, folder):
    return repetition.judge_repetition(table(spark, folder, "documents"))


_SPACES = r"[\x20\x09-\x0D]"
_MOST = max(repetition.SHORT, *repetition.LIMITS)


def _windows(n: int) -> str:
    later = ", ".join(f"x{j}" for j in range(1, n))
    return f"SELECT doc_id, {n} AS n, i, concat_ws(' ', x, {later}) AS s FROM ahead WHERE x{n - 1} IS NOT NULL"


_OVER = " OR ".join(f"100 * coalesce(repeat_chars_{n}, 0) > {percent} * word_chars" for n, percent in repetition.LIMITS.items())
SQL["op11_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
lines AS (SELECT doc_id, regexp_replace(s, '{_SPACES}', '', 'g') AS bare, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS r
          FROM (SELECT doc_id, string_split(t, chr(10))[i] AS s, i FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i))),
line AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(bare)) AS dup_line_chars FROM lines WHERE r > 1 AND bare <> '' GROUP BY doc_id),
words AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
ahead AS (SELECT doc_id, i, x, {', '.join(f"lead(x, {j}) OVER o AS x{j}" for j in range(1, _MOST))} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, n, i, count(*) OVER same AS c, row_number() OVER (same ORDER BY i) AS r
            FROM ({' UNION ALL '.join(_windows(n) for n in (repetition.SHORT, *repetition.LIMITS))}) WINDOW same AS (PARTITION BY doc_id, n, s)),
places AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM windows WHERE c > 1 AND (r > 1 OR n = {repetition.SHORT})),
chars AS (SELECT doc_id, {', '.join(f"sum(length(x)) FILTER (n = {n}) AS repeat_chars_{n}" for n in repetition.LIMITS)},
          count(*) FILTER (n = {repetition.SHORT}) AS n_repeat_words FROM places JOIN words USING (doc_id, i) GROUP BY doc_id),
every AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
          CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {', '.join(f"CAST(coalesce(repeat_chars_{n}, 0) AS BIGINT) AS repeat_chars_{n}" for n in repetition.LIMITS)}
          FROM own LEFT JOIN line USING (doc_id) LEFT JOIN chars USING (doc_id)),
judged AS (SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.SHORT_LIMIT} * n_words AS base_failed FROM every)
SELECT *, NOT base_failed AND NOT ({_OVER} OR 100 * dup_line_chars > {repetition.LINE_LIMIT} * word_chars OR 100 * n_symbols > {repetition.SYMBOL_LIMIT} * n_words) AS kept FROM judged"""


@query
def op12_ranked_search(spark, folder):
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
m AS (SELECT doc_id, 75 + (25 * len(t) * n) // l AS m FROM d, total),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""


@query
def op13_spelling_variants(spark, folder):
    return spelling.group_variants(table(spark, folder, "documents"))


# DuckDB has no crc32: it is folded over the bytes of a text, by a table made from the polynomial.
SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(i))),
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT doc_id, run, times, flatten(list_transform(string_split(doc_id || ':' || run, ''),
          lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END)) AS b FROM runs),
hashed AS (SELECT run, times, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, crc),
counted AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counted)),
near AS (SELECT DISTINCT * FROM (
         SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
         UNION ALL SELECT a.rest, a.word, a.n FROM cut a JOIN counted c ON c.word = a.rest
         UNION ALL SELECT a.word, a.rest, c.n FROM cut a JOIN counted c ON c.word = a.rest)),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -other_n, w := other)) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT counted.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.w END AS form, CASE WHEN -b.m >= 5 * n THEN CAST(-b.m AS BIGINT) END AS form_n
           FROM counted LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL),
last AS (SELECT walk.word, root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN last USING (word)"""
