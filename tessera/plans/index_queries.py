"""Queries over written indexes of the documents: stems, postings, ranked search, substrings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stems import STOP_WORDS, stem, stem_ctes
from tessera.operators import fulltext
from tessera.plans.views import table
from tessera.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: First line, source, the rest and language of a document as the texts of the classes A to D.
PARTS_SQL = r"""parts as (
    select doc_id, 'A' as class, 1 as part, split_part(coalesce(text, ''), chr(10), 1) as t from documents union all
    select doc_id, 'B', 2, coalesce(source, '') from documents union all
    select doc_id, 'C', 3, substr(coalesce(text, ''), len(split_part(coalesce(text, ''), chr(10), 1)) + 1) from documents union all
    select doc_id, 'D', 4, coalesce(lang, '') from documents
),
tokens as (select doc_id, class, part, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) as word, generate_subscripts(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), 1) as i from parts),
placed as (select doc_id, class, word, row_number() over (partition by doc_id order by part, i) as position from tokens),
kept as (select * from placed where word not in (""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + r""")),
vocabulary as (select distinct word from kept union select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) from benchmark),
""" + stem_ctes("vocabulary") + """,
lexemes as (select doc_id, class, position, stem from kept join stems using (word))"""


def parts() -> dict:
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, "\n", 1)
    return {"A": first, "B": F.col("source"), "C": F.substring(text, F.length(first) + 1, F.length(text)), "D": F.col("lang")}


#: Folders of the indexes; the tables are small.
BUCKETS = 8


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-index-{uuid.uuid4().hex}"


def _index(spark: SparkSession, sf_dir: str) -> fulltext.TextIndex:
    path = _folder(spark)
    fulltext.write_postings(fulltext.lexemes(table(spark, sf_dir, "documents"), "doc_id", parts()).withColumn("id", F.col("id").cast("string")), path, BUCKETS)
    return fulltext.TextIndex(spark, path, BUCKETS)


@query("with words as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from documents),\n" + stem_ctes("words") + " select word, stem from stems")
def word_stems(spark, sf_dir):
    """Every distinct word of the documents and its stem."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(fulltext.WORD), F.lit(0))).alias("word")).distinct()
    return words.withColumn("stem", stem("word"))


@query(f"with {PARTS_SQL} select stem, count(distinct doc_id) as n_docs, count(*) as n_places, count(case when class = 'A' then 1 end) as n_first_line, min(position) as earliest from lexemes group by stem")
def posting_sizes(spark, sf_dir):
    """Records, places, places in first lines and earliest place of each stem, read from the inverted table."""
    return fulltext.sizes(_index(spark, sf_dir).blocks)


RANK_SQL = """
worth as (
    select query, doc_id, k, sum(w / (i * i)) as worth from (
        select query, doc_id, k, w, row_number() over (partition by query, doc_id, k order by w desc) as i from (
            select query, doc_id, k, case class when 'A' then 1.0::double when 'B' then 0.4::double when 'C' then 0.2::double else 0.1::double end as w from asked join lexemes on stem = word_stem))
    group by query, doc_id, k
),
near as (
    select a.query, x.doc_id, a.k, 0.5::double / min(abs(x.position - y.position)) as near
    from asked a join asked b on b.query = a.query and b.k = a.k + 1 join lexemes x on x.stem = a.word_stem join lexemes y on y.stem = b.word_stem and y.doc_id = x.doc_id
    group by a.query, x.doc_id, a.k
),
n as (select query, count(*) as n from asked group by query),
sums as (select query, doc_id, sum(worth) as worth, count(*) as held from worth group by query, doc_id),
close as (select query, doc_id, sum(near) as near from near group by query, doc_id),
ranked as (select s.query, s.doc_id, s.held, n.n, round(s.worth / n.n + coalesce(c.near, 0), 6) as rank from sums s join n using (query) left join close c on c.query = s.query and c.doc_id = s.doc_id)"""

#: Two words and a stop word; the forms in which they are asked for are not those of the texts.
ASKED = "The things eroned, eres"


@query(f"""with {PARTS_SQL},
asked as (select * from (values (0, 0, 'thing'), (0, 1, 'eron'), (0, 2, 'ere')) t(query, k, word_stem)), {RANK_SQL}
select doc_id, rank from ranked""")
def fulltext_any(spark, sf_dir):
    """Documents that hold any word of a query, by stems, with their rank."""
    return _index(spark, sf_dir).search(ASKED, every=False).select(F.col("id").cast("long").alias("doc_id"), F.round("rank", 6).alias("rank"))


#: Each benchmark item's first line as a query.
BATCH_SQL = """asked_words as (select item_id as query, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{L}\\p{N}]+')) as word, generate_subscripts(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\\p{L}\\p{N}]+'), 1) as i from benchmark),
asked as (select query, row_number() over (partition by query order by min(i)) - 1 as k, stem as word_stem from asked_words join stems using (word) where word not in (""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + """) group by query, stem)"""


@query(f"with {PARTS_SQL}, {BATCH_SQL}, {RANK_SQL} select query as item_id, doc_id, rank from ranked where held = n")
def fulltext_batch(spark, sf_dir):
    """Documents that hold every word of a benchmark item's first line, by stems, with their rank: all items at once."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.substring_index("text", "\n", 1).alias("q"))
    found = _index(spark, sf_dir).search_all(queries)
    return found.select(F.col("query").alias("item_id"), F.col("id").cast("long").alias("doc_id"), F.round("rank", 6).alias("rank"))


#: Patterns to look for: with common and rare grams, across lines of case, too short for a gram, in no text, and with wildcards.
PATTERNS = ["the ", "ENTR", "src1", "a", "zzzqqq", "http://"]
WILD = ["t_e %and", "src_9", "%"]


@query("select q, doc_id from (values " + ", ".join(f"('{p}')" for p in PATTERNS) + ") t(q), documents where contains(lower(text), lower(q)) or contains(lower(source), lower(q))\nunion all select q, doc_id from (values " + ", ".join(f"('{p}')" for p in WILD) + ") t(q), documents where text ilike '%' || q || '%' or source ilike '%' || q || '%'")
def substring_search(spark, sf_dir):
    """Documents of which text or source contains a pattern, found through trigrams."""
    docs, path = table(spark, sf_dir, "documents"), _folder(spark)
    fulltext.write_grams(docs, "doc_id", ["text", "source"], path, BUCKETS)
    index = fulltext.GramIndex(docs, "doc_id", ["text", "source"], path, BUCKETS)
    out = None
    for q, wild in [(q, False) for q in PATTERNS] + [(q, True) for q in WILD]:
        found = index.search(q, wild).select(F.lit(q).alias("q"), "doc_id")
        out = found if out is None else out.unionByName(found)
    return out
