"""Queries over what a search page shows, each beside its SQL for DuckDB. Inputs are put together from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..sources.tables import table

#: Expressions that Spark and DuckDB read alike.
QUERY = "case p_partkey % 5 when 0 then concat('AB-', p_partkey, 'X') when 1 then concat(p_size, '/', p_partkey) when 2 then p_name when 3 then concat('  ', p_partkey, '-', p_size, 'B ') else concat('SENSOR', p_size) end"
TOKENS = "case p_partkey % 4 when 0 then concat(p_name, ' AB-', p_partkey, 'X Q', p_size, '9') when 1 then p_name when 2 then concat('ab1 ', p_brand, ' A1') else concat('N', p_partkey, '0') end"
ATTRIBUTE = "case p_partkey % 6 when 0 then 'Stock' when 1 then 'brand logo' when 2 then ' ' else p_name end"
VALUE = "case p_partkey % 7 when 0 then concat('/images/', p_size, '.png') when 1 then concat('see //cdn.example/', p_size) when 2 then concat('[x](', p_size, ')') when 3 then concat('cdn/images/', p_size) else concat(p_size, ' mm') end"
SHEET = "case p_partkey % 4 when 0 then concat('size: ', p_size, ' mm') when 1 then concat('size: ', p_size, '. brand: ', p_brand) when 2 then concat(repeat(p_name, 12), ' size: ', p_size) else p_name end"
LABEL = "case p_partkey % 4 when 0 then concat('Siemens_', p_brand, '__max') when 1 then concat(' mouser_', p_size, '_v ') when 2 then '' else concat(p_type, '_of_', p_name) end"
SOURCE = "case p_partkey % 5 when 0 then concat('https://www.ebay.example/', p_size) when 1 then concat('https://shop.maker.example/', p_size) when 2 then 'not a url' else concat('https://maker.example/amazon/', p_size) end"
KIND = "case p_partkey % 6 when 0 then 'inductive sensor and servo motor' when 1 then 'Servo Drive' when 2 then 'remote I/O' when 3 then 'pressure sensor' when 4 then 'servo motor' else p_name end"
FILE = "case p_partkey % 5 when 0 then concat('https://x.example/a/dgsl-', p_size, '.pdf') when 1 then concat('https://x.example/DNC_', p_size) when 2 then concat('https://x.example/DNX', p_size, '?a=ADN') when 3 then 'ADN' else concat('https://x.example/adn/', p_size) end"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part_id").withColumn("p_partkey", F.col("part_id"))


def part_number_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.is_part_number_query(F.expr(QUERY)).alias("is_part_number"))


def query_part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.query_part_number(F.expr(TOKENS)).alias("found"))


def displayable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.is_displayable(F.expr(ATTRIBUTE), F.expr(VALUE)).alias("shown"))


def specification_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.is_specification_blob(F.expr(SHEET)).alias("is_blob"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.humanised(F.expr(LABEL)).alias("label"))


def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document stand for its pages; the needle is its language's code."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", display.first_page(F.col("lang"), F.split("text", "\n")).alias("page"))


def marketplaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.is_marketplace(F.expr(SOURCE)).alias("is_marketplace"))


def reference_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("part_id", display.reference_category(F.col("p_type"), F.expr(KIND), F.lit(None)).alias("category"))


def file_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = display.file_prefix(F.expr(FILE))
    return _part(spark, sf_dir).select("part_id", prefix.alias("prefix"), display.file_family(prefix).alias("family"))


def given_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    value, low, high = (F.when(F.col("l_linenumber") % k == 0, c) for k, c in ((2, F.col("l_returnflag")), (3, F.col("l_quantity")), (5, F.col("l_discount"))))
    return li.filter(display.is_given(value, low, high)).groupBy(F.col("l_suppkey").alias("supplier_id")).agg(F.count("*").alias("n_given"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (part_number_queries, query_part_numbers, displayable_rows, specification_blobs, raw_labels, first_pages, marketplaces, reference_categories, file_prefixes, given_specs)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    x = lambda sql: f"with x as (select p_partkey as part_id, p_type, trim({sql}) as v from part) "
    commercial = ", ".join(f"'{c}'" for c in display.COMMERCIAL)
    prefixes = " ".join(f"when starts_with(n, '{p}') then '{p}'" for p in display.FILE_PREFIXES)
    kinds = " ".join(f"when regexp_matches(r, '{words}') then '{kind}'" for kind, words in display.CATEGORIES)
    return {
        "part_number_queries": x(QUERY) + r"select part_id, length(v) >= 3 and length(v) <= 40 and not regexp_matches(v, '[0-9]\s*/\s*[0-9]') and regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '^([A-Za-z]{1,8}[-_.]?[0-9][A-Za-z0-9/_.-]{1,30}|[0-9][A-Za-z0-9/_.-]{2,39})$') as is_part_number from x",
        "query_part_numbers": x(TOKENS) + r"select part_id, coalesce(list_filter(string_split_regex(v, '\s+'), lambda t: regexp_full_match(t, '[A-Z]{1,4}-?[0-9][A-Z0-9-]{1,12}'))[1], '') as found from x",
        "displayable_rows": f"with x as (select p_partkey as part_id, trim({ATTRIBUTE}) as a, trim({VALUE}) as v from part) select part_id, a <> '' and v <> '' and lower(a) not in ({commercial}) and not regexp_matches(a || ' ' || v, '{display.MARKUP}') "
        f"and not regexp_matches(v, '{display.ASSET}') and not (regexp_matches(a, '{display.DECORATION}') and regexp_matches(v, '{display.IMAGE_PATH}')) as shown from x",
        "specification_blobs": x(SHEET) + r", c as (select *, len(regexp_extract_all(v, '[^:]{2,80}:\s*[^:]{1,120}')) as n from x) select part_id, n >= 2 or (n = 1 and length(v) > 120) as is_blob from c",
        "raw_labels": x(LABEL) + r", s as (select part_id, trim(regexp_replace(replace(regexp_replace(v, '^(siemens|mouser|analog|diodes)_', '', 'i'), '_', ' '), '\s+', ' ', 'g')) as s from x) select part_id, upper(left(s, 1)) || substr(s, 2) as label from s",
        "first_pages": "with l as (select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), h as (select doc_id, min(n) as page from l where lang <> '' and contains(line, lang) group by 1) select doc_id, page::bigint as page from documents left join h using (doc_id)",
        "marketplaces": x(SOURCE) + f"select part_id, regexp_matches(regexp_extract(v, '^[a-z]+://([^/?#:]+)', 1), '{display.MARKETPLACES}') as is_marketplace from x",
        "reference_categories": x(KIND) + f", r as (select *, lower(p_type || ' ' || v || ' ') as r from x) select part_id, case {kinds} else p_type end as category from r",
        "file_prefixes": x(FILE) + f", n as (select part_id, upper(regexp_extract(v, '^[a-z]+://[^?#]*/([^/?#]*)', 1)) as n from x), f as (select part_id, case {prefixes} end as prefix from n) select *, case when prefix in ('DGST', 'DGSL') then 'pneumatic_mini_slide' else 'pneumatic_cylinder' end as family from f",
        "given_specs": "select l_suppkey as supplier_id, count(*) as n_given from lineitem where (l_linenumber % 2 = 0 and l_returnflag <> '') or l_linenumber % 3 = 0 or l_linenumber % 5 = 0 group by 1",
    }
