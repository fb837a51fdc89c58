"""Queries: text corpus preparation and vocabulary coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as fn
from tidemark.functions.rounding import rounded
from tidemark.operators import joins, text
from tidemark.plans.cleaning import split_sql
from tidemark.plans.registry import Tables, query, r


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
SQL_STOP = "(" + ", ".join(quoted(w) for w in fn.STOP_WORDS) + ")"


def words_sql(text_sql: str) -> str:
    return f"list_filter(string_split_regex({text_sql}, '{SQL_SPACE}'), lambda w: w <> '')"


def separated_sql(text_sql: str) -> str:
    marks = quoted(fn.SEPARATORS)
    blanks = quoted(" " * len(fn.SEPARATORS))
    return (
        f"list_filter(string_split(translate(lower({text_sql}), {marks}, {blanks}), ' '),"
        " lambda w: w <> '')"
    )


TOKENS = f"list_filter({words_sql('lower(text)')}, lambda w: w NOT IN {SQL_STOP})"


@query(
    "word_count",
    "T1 A13",
    "SELECT unnest(string_split(text, ' ')) AS word, count(*) AS n FROM conversations GROUP BY 1",
)
def word_count(t: Tables) -> DataFrame:
    return text.word_count(t.conversations, "text", " ")


@query(
    "comma_token_count",
    "T2",
    "SELECT unnest(string_split(text, ',')) AS word, count(*) AS n FROM documents GROUP BY 1",
)
def comma_token_count(t: Tables) -> DataFrame:
    return text.word_count(t.documents, "text", ",")


@query(
    "line_count",
    "T3",
    "SELECT unnest(string_split(text, chr(10))) AS line, count(*) AS n FROM documents GROUP BY 1",
)
def line_count(t: Tables) -> DataFrame:
    return text.line_count(text.lines_of(t.documents, "text"))


@query(
    "lower_tokens",
    "T4",
    f"""WITH w AS (SELECT doc_id, {words_sql('lower(text)')} AS k FROM documents)
    SELECT doc_id, unnest(k) AS word, (generate_subscripts(k, 1) - 1)::INT AS pos FROM w""",
)
def lower_tokens(t: Tables) -> DataFrame:
    rows = text.tokenize(t.documents.select("doc_id", "text"), "text", stop=None)
    return rows.select("doc_id", F.posexplode("tokens").alias("pos", "word"))


@query(
    "tokens_without_stop_words",
    "T5",
    f"""SELECT doc_id, unnest({TOKENS}) AS word, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def tokens_without_stop_words(t: Tables) -> DataFrame:
    rows = text.tokenize(t.documents.select("doc_id", "text"), "text")
    return text.count_tokens(rows, F.col("tokens"), ["doc_id"])


_WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]+"


@query(
    "word_and_punctuation_tokens",
    "T6 T5 U2",
    f"""SELECT role, unnest(list_filter(regexp_extract_all(text, '{_WORD_PUNCT}'),
        lambda w: lower(w) NOT IN {SQL_STOP})) AS word, count(*) AS n
        FROM conversations GROUP BY 1, 2""",
)
def word_and_punctuation_tokens(t: Tables) -> DataFrame:
    tokens = fn.without(fn.words_and_punctuation(F.col("text")), fn.STOP_WORDS, ignore_case=True)
    return text.count_tokens(t.conversations, tokens, ["role"])


@query(
    "top_words",
    "T7 X4",
    f"""WITH c AS (SELECT unnest({TOKENS}) AS word, count(*) AS n FROM documents GROUP BY 1),
    k AS (SELECT * FROM c ORDER BY n DESC, word LIMIT 10)
    SELECT word, n, {r("n * 100.0::DOUBLE / sum(n) OVER ()")} AS percent FROM k""",
)
def top_words(t: Tables) -> DataFrame:
    rows = text.tokenize(t.documents, "text")
    counts = text.count_tokens(rows, F.col("tokens"))
    return rounded(text.top_with_percent(counts, 10), "percent")


def _grams_sql(tokens: str) -> str:
    return f"""list_transform(range(1, len({tokens}) - 1),
        lambda i: {tokens}[i] || ' ' || {tokens}[i + 1] || ' ' || {tokens}[i + 2])"""


@query(
    "top_trigrams",
    "T8",
    f"""WITH w AS (SELECT {TOKENS} AS k FROM documents),
    c AS (SELECT unnest({_grams_sql('k')}) AS word, count(*) AS n FROM w GROUP BY 1),
    k AS (SELECT * FROM c ORDER BY n DESC, word LIMIT 10)
    SELECT word, n, {r("n * 100.0::DOUBLE / sum(n) OVER ()")} AS percent FROM k""",
)
def top_trigrams(t: Tables) -> DataFrame:
    rows = text.tokenize(t.documents, "text")
    return rounded(text.top_with_percent(text.ngram_count(rows, "tokens", 3), 10), "percent")


_CLEAN = (
    f"translate(translate(text, {quoted(fn.SPACED)}, '   '), {quoted(fn.REMOVED)}, '')"
)


@query("clean_text", "T9", f"SELECT doc_id, {_CLEAN} AS text FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return text.clean_text(t.documents.select("doc_id", "text"), "text")


@query(
    "vocabulary",
    "T10",
    f"SELECT unnest({words_sql('text')}) AS word, count(*) AS n FROM documents GROUP BY 1",
)
def vocabulary(t: Tables) -> DataFrame:
    return text.vocabulary(t.documents, "text")


_INDEX = f"""c AS (SELECT unnest({separated_sql('text')}) AS word, count(*) AS n
        FROM documents GROUP BY 1),
    x AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM c
        QUALIFY id <= 49999)"""


@query("word_index", "T11", f"WITH {_INDEX} SELECT word, id::INT AS id FROM x")
def word_index(t: Tables) -> DataFrame:
    return text.word_index(t.documents, "text", 50_000)


_SEQ = f"""{_INDEX}, w AS (SELECT doc_id, {separated_sql('text')} AS k FROM documents),
    e AS (SELECT doc_id, unnest(k) AS word, generate_subscripts(k, 1) AS spot FROM w),
    s AS (SELECT doc_id, id::INT AS id,
        row_number() OVER (PARTITION BY doc_id ORDER BY e.spot) AS pos,
        count(*) OVER (PARTITION BY doc_id) AS len FROM e JOIN x USING (word))"""


@query(
    "text_to_ids",
    "T12",
    f"WITH {_SEQ} SELECT doc_id, (pos - 1)::INT AS pos, id FROM s",
)
def text_to_ids(t: Tables) -> DataFrame:
    index = text.word_index(t.documents, "text", 50_000)
    rows = text.to_sequences(t.documents, index, "doc_id", "text")
    return rows.select("doc_id", F.posexplode("ids").alias("pos", "id"))


_PADDED = f"""WITH {_SEQ}, p AS (SELECT doc_id, unnest(range(100)) AS pos FROM documents)
    SELECT p.doc_id, p.pos::INT AS pos, coalesce(s.id, 0) AS id FROM p LEFT JOIN s
    ON s.doc_id = p.doc_id AND s.pos - s.len + 99 = p.pos"""


@query("padded_ids", "T13 T14", _PADDED)
def padded_ids(t: Tables) -> DataFrame:
    docs = text.fill_text(t.documents.select("doc_id", "text"), ["text"])
    index = text.word_index(docs, "text", 50_000)
    rows = text.pad(text.to_sequences(docs, index, "doc_id", "text"), "ids", 100)
    return rows.select("doc_id", F.posexplode("ids").alias("pos", "id"))


@query(
    "prepared_corpus",
    "T14 X7",
    f"""WITH d AS (SELECT doc_id, text, {split_sql(0.1)} AS split FROM documents),
    c AS (SELECT unnest({separated_sql('text')}) AS word, count(*) AS n FROM d
        WHERE split = 'train' GROUP BY 1),
    x AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM c
        QUALIFY id <= 49999),
    w AS (SELECT doc_id, {separated_sql('text')} AS k FROM d),
    e AS (SELECT doc_id, unnest(k) AS word, generate_subscripts(k, 1) AS spot FROM w),
    s AS (SELECT doc_id, id::INT AS id,
        row_number() OVER (PARTITION BY doc_id ORDER BY e.spot) AS pos,
        count(*) OVER (PARTITION BY doc_id) AS len FROM e JOIN x USING (word)),
    p AS (SELECT doc_id, split, unnest(range(100)) AS pos FROM d)
    SELECT p.doc_id, p.split, p.pos::INT AS pos, coalesce(s.id, 0) AS id FROM p LEFT JOIN s
        ON s.doc_id = p.doc_id AND s.pos - s.len + 99 = p.pos""",
)
def prepared_corpus(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    rows = text.prepare(docs, "doc_id", "text", 50_000, 100)
    return rows.select("doc_id", "split", F.posexplode("ids").alias("pos", "id"))


_CLASS_TOKENS = f"""w AS (SELECT l.toxic, {TOKENS} AS k
    FROM documents JOIN labels l USING (doc_id))"""


@query(
    "top_words_per_class",
    "T15 T7",
    f"""WITH {_CLASS_TOKENS}, c AS (SELECT toxic, unnest(k) AS word, count(*) AS n FROM w
        GROUP BY 1, 2),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY n DESC, word)
        <= 10)
    SELECT toxic, word, n, {r("n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY toxic)")} AS percent
    FROM k""",
)
def top_words_per_class(t: Tables) -> DataFrame:
    counts = text.count_tokens(_labelled(t), F.col("tokens"), ["toxic"])
    return rounded(text.top_with_percent(counts, 10, ["toxic"]), "percent")


@query(
    "top_trigrams_per_class",
    "T15 T8",
    f"""WITH {_CLASS_TOKENS}, c AS (SELECT toxic, unnest({_grams_sql('k')}) AS word, count(*) AS n
        FROM w GROUP BY 1, 2),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY n DESC, word)
        <= 10)
    SELECT toxic, word, n, {r("n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY toxic)")} AS percent
    FROM k""",
)
def top_trigrams_per_class(t: Tables) -> DataFrame:
    counts = text.ngram_count(_labelled(t), "tokens", 3, ["toxic"])
    return rounded(text.top_with_percent(counts, 10, ["toxic"]), "percent")


def _labelled(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id")
    return text.tokenize(docs, "text").select("toxic", "tokens")


def word_vectors(t: Tables) -> DataFrame:
    """Words of the conversations with small vectors made from their counts."""
    counts = text.vocabulary(t.conversations, "text")
    size = F.length("word")
    vector = F.array(F.col("n").cast("float"), size.cast("float"))
    return counts.select("word", vector.alias("vector"))


_COVER = f"""v AS (SELECT unnest({words_sql('text')}) AS word, count(*) AS n FROM documents
        GROUP BY 1),
    k AS (SELECT unnest({words_sql('text')}) AS word, count(*) AS m FROM conversations
        GROUP BY 1)"""


@query(
    "vocabulary_lookup",
    "J2",
    f"""WITH {_COVER} SELECT v.word, v.n, k.word IS NOT NULL AS known
        FROM v LEFT JOIN k USING (word)""",
)
def vocabulary_lookup(t: Tables) -> DataFrame:
    return joins.lookup(text.vocabulary(t.documents, "text"), word_vectors(t))


@query(
    "vocabulary_coverage",
    "J2",
    f"""WITH {_COVER} SELECT count(k.word) AS known_words,
        count(*) - count(k.word) AS unknown_words,
        {r("count(k.word) * 100.0::DOUBLE / count(*)")} AS percent_of_vocab,
        {r("sum(CASE WHEN k.word IS NOT NULL THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n)")}
            AS percent_of_text FROM v LEFT JOIN k USING (word)""",
)
def vocabulary_coverage(t: Tables) -> DataFrame:
    out = joins.coverage(text.vocabulary(t.documents, "text"), word_vectors(t))
    return rounded(out, "percent_of_vocab", "percent_of_text")


@query(
    "unknown_words",
    "J3",
    f"WITH {_COVER} SELECT v.word, v.n FROM v ANTI JOIN k USING (word) ORDER BY n DESC, word",
)
def unknown_words(t: Tables) -> DataFrame:
    return joins.unknown_words(text.vocabulary(t.documents, "text"), word_vectors(t))


@query(
    "add_lower_case_words",
    "J4",
    f"""WITH {_COVER}, u AS (SELECT lower(k.word) AS low, arg_min(k.m, k.word) AS m,
        arg_min(length(k.word), k.word) AS size FROM k SEMI JOIN v USING (word) GROUP BY 1)
    SELECT word, m::DOUBLE AS first, length(word)::DOUBLE AS second FROM k
    UNION ALL SELECT low, m::DOUBLE, size::DOUBLE FROM u
        WHERE low NOT IN (SELECT word FROM k)""",
)
def add_lower_case_words(t: Tables) -> DataFrame:
    out = joins.add_lower_case(word_vectors(t), text.vocabulary(t.documents, "text"))
    return out.select(
        "word",
        F.get("vector", F.lit(0)).cast("double").alias("first"),
        F.get("vector", F.lit(1)).cast("double").alias("second"),
    )
