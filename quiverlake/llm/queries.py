"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm._common import read
from quiverlake.llm.ann import nearest
from quiverlake.llm.fingerprints import fingerprint_edits
from quiverlake.llm.language import fit_language, predict_language
from quiverlake.llm.licenses import ANCHORS, LAST, TEMPLATES, WORDS, scan
from quiverlake.llm.main_text import extract_main_text
from quiverlake.llm.mixing import mix, words_taken
from quiverlake.llm.packing import pack_documents
from quiverlake.llm.quality import featurise, fit_quality, score_quality
from quiverlake.llm.simhash import simhash_groups
from quiverlake.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), limit=4096)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit_language(docs, ~held_out)
    return predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(*mix(read(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths three folders deep and deeper: source, thousand, hundred, and one more for two in three documents.

    The document that opens a thousand or a hundred is the license file of that folder.
    """
    i = F.col("doc_id")
    part = lambda c: F.floor(c).cast("string")
    thousand = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), part(i / 1000))
    hundred = F.concat(thousand, F.lit("/"), part(i / 100))
    deep = F.when(F.pmod(i, F.lit(3)) > 0, F.concat(F.lit("/d"), F.pmod(i, F.lit(7)).cast("string"))).otherwise(F.lit(""))
    path = F.when(F.pmod(i, F.lit(1000)) == 0, F.concat(thousand, F.lit("/LICENSE"))).when(F.pmod(i, F.lit(100)) == 0, F.concat(hundred, F.lit("/LICENSE")))
    return scan(read(spark, sf_dir, "documents"), "doc_id", path.otherwise(F.concat(hundred, deep, F.lit("/"), i.cast("string"), F.lit(".txt"))))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = featurise(read(spark, sf_dir, "documents"), "doc_id", "text")
    return score_quality(features, fit_quality(features))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_source_mixing": op4_source_mixing,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_nearest": op8_nearest,
    "op9_main_text": op9_main_text,
    "op10_fingerprints": op10_fingerprints,
}

def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ANCHORED = f"regexp_matches(lower(line), '{ANCHORS}')"
_OP5_SQL = f"""
with named as (select doc_id, text, '/' || coalesce(source, 'none') || '/' || (doc_id // 1000) as thousand, '/' || (doc_id // 100) as hundred from documents),
files as (
  select doc_id, text, case when doc_id % 1000 = 0 then thousand || '/LICENSE' when doc_id % 100 = 0 then thousand || hundred || '/LICENSE'
    else thousand || hundred || case when doc_id % 3 > 0 then '/d' || (doc_id % 7) else '' end || '/' || doc_id || '.txt' end as path
  from named),
held as (select distinct * from files where regexp_matches(lower(text), '{ANCHORS}')),
pieces as (
  select doc_id, path, 0 as kind, generate_subscripts(l, 1) as pos, unnest(l) as line from (select doc_id, path, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) as l from held)
  union all select doc_id, path, 1, pos, line from (select doc_id, path, generate_subscripts(l, 1) as pos, unnest(l) as line from (select doc_id, path, string_split(text, chr(10) || chr(10)) as l from held)) where contains(line, chr(10))
  union all select doc_id, path, 2, 1, text from held),
passages as (select row_number() over () as num, doc_id, path, regexp_extract_all(lower(line), '{WORDS}') as words from pieces where {_ANCHORED}),
counted as (select num, doc_id, path, word, count(*) as tf from (select num, doc_id, path, unnest(words) as word from passages) group by all),
total as (select count(*) as n from passages),
frequency as (select word, count(*) as df from counted group by word),
templates(template, license, notice) as (values {", ".join(f"({k}, {_literal(a)}, {_literal(b)})" for k, (a, b) in enumerate(TEMPLATES))}),
terms as (
  select template, license, t.word, t.tf, t.tf * (ln((1.0::double + n) / (1.0 + coalesce(df, 0))) + 1.0) as w
  from (select template, license, word, count(*) as tf from (select template, license, unnest(regexp_extract_all(lower(notice), '{WORDS}')) as word from templates) group by all) t
  left join frequency f on f.word = t.word, total),
unit as (select template, license, word, sum(tf) over (partition by template) as t_words, w / sqrt(sum(w * w) over (partition by template)) as tw from terms),
weighed as (
  select num, doc_id, path, word, w, sqrt(sum(w * w) over (partition by num)) as norm
  from (select c.*, tf * (ln((1.0::double + n) / (1.0 + df)) + 1.0) as w from counted c join frequency f on f.word = c.word, total)),
scored as (select doc_id, path, license, t_words, round(sum(w * tw) / max(norm), 6) as score from weighed p join unit u on u.word = p.word group by num, doc_id, path, template, license, t_words),
own as (
  select doc_id, path, license, score from (
    select *, row_number() over (partition by doc_id, path order by license = '{LAST}', score desc, t_words desc, license) as n from (select doc_id, path, license, t_words, max(score) as score from scored where score >= 0.6 group by all))
  where n = 1),
licensed as (select regexp_replace(path, '/?[^/]*$', '') as above, arg_max(license, (score, license)) as license from own where path like '%/LICENSE' group by 1),
up as (select folder, unnest(range(1, len(parts) + 1)) as depth, parts from (select distinct regexp_replace(path, '/?[^/]*$', '') as folder, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') as parts from files)),
nearest as (select folder, arg_max(l.above, depth) as above, arg_max(l.license, depth) as license from up join licensed l on l.above = array_to_string(parts[1:depth], '/') group by folder)
select f.doc_id, f.path, o.license as own_license, o.score as own_score, coalesce(o.license, b.license) as license,
  case when o.license is null then b.above end as license_from
from files f left join own o on o.doc_id = f.doc_id and o.path = f.path left join nearest b on b.folder = regexp_replace(f.path, '/?[^/]*$', '')
"""

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op5_licenses": _OP5_SQL}
