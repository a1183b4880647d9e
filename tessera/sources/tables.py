"""Driver tables and the adapters that read them as chunks, items, steps, …"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import numbered


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # A leaf of which Spark doesn't know the size tells the largest one there is.
    return sum(x for x in sizes if x < 1 << 55)


#: Bytes of a table below which it is dealt out without a look at its parts.
LOOK_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: a table that is read in fewer parts than half the cores (a small
    one, often one row group) is dealt out first. Others stay as they are read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    unit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = input_bytes(df)
    if size >= cores * unit:
        return df
    # Parts that have rows are told by the files' footers: a row group is not divided.
    if size >= LOOK_BYTES and df.select(F.spark_partition_id()).distinct().count() * 2 >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunk rows: source_path, chunk_index, content, section_id."""
    docs = table(spark, sf_dir, "documents")
    rows = numbered(docs, "source", "doc_id", "chunk_index", "int")
    return rows.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("text").alias("content"), F.lit("local").alias("source_kind"), F.col("source").alias("source_path"), "chunk_index", F.col("lang").alias("section_id"), F.upper("lang").alias("section_title"))


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk rows without their index: within a source they stand in the order of doc_id,
    so searches score and cut them before anything is numbered."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("text").alias("content"), F.lit("local").alias("source_kind"), F.col("source").alias("source_path"), F.col("lang").alias("section_id"), F.upper("lang").alias("section_title"))


def with_index(rows: DataFrame) -> DataFrame:
    """Rows of whole sources (source_path, doc_id) with their chunk_index."""
    return numbered(rows, "source_path", "doc_id", "chunk_index", "int")


def located(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """A search's few rows (with source_path and doc_id) with their chunk_index: how many
    documents of the source come before."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("_source"), F.col("doc_id").alias("_doc"))
    before = docs.join(F.broadcast(found), (F.col("_source") == F.col("source_path")) & (F.col("_doc") <= F.col("doc_id")))
    return before.groupBy(*found.columns).agg((F.count(F.lit(1)) - 1).cast("int").alias("chunk_index"))


CHUNKS_SQL = """chunks as (select doc_id::varchar as id, doc_id, text as content, 'local' as source_kind, source as source_path,
  (row_number() over (partition by source order by doc_id) - 1)::int as chunk_index, lang as section_id, upper(lang) as section_title from documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as parsed items: doc, pos, label, level, text."""
    role = F.col("role")
    level = F.when(role == "system", 1).when(role == "user", 2)
    label = F.when(level.isNotNull(), "section_header").otherwise("paragraph")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), label.alias("label"), level.alias("level"), "text")


ITEMS_SQL = """items as (select conv_id as doc, turn as pos, case when role in ('system', 'user') then 'section_header' else 'paragraph' end as label,
  case role when 'system' then 1 when 'user' then 2 end as level, text from conversations)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer as sections of levels 1 to 3, one document a region."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    one = r.select(F.col("r_name").alias("source_path"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit(1).alias("level"), F.array().cast("array<string>").alias("chain"), F.lit(1).alias("chunk_count"), F.lit(0).cast("long").alias("ordinal"))
    nations = n.join(r, n.n_regionkey == r.r_regionkey)
    two = nations.select(F.col("r_name").alias("source_path"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit(2).alias("level"), F.array(F.concat(F.lit("r"), "r_regionkey")).alias("chain"), F.lit(1).alias("chunk_count"), (F.col("n_nationkey") + 1).cast("long").alias("ordinal"))
    three = c.join(orders, "c_custkey", "left").join(nations, c.c_nationkey == F.col("n_nationkey"))
    three = three.select(F.col("r_name").alias("source_path"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(3).alias("level"), F.array(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "n_nationkey")).alias("chain"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), (F.col("c_custkey") + 1000).cast("long").alias("ordinal"))
    return one.unionByName(two).unionByName(three)


CATALOG_SQL = """catalog as (
  select r_name as source_path, 'r' || r_regionkey as id, r_name as title, 1 as level, []::varchar[] as chain, 1 as chunk_count, 0::bigint as ordinal from region
  union all select r_name, 'n' || n_nationkey, n_name, 2, ['r' || r_regionkey], 1, (n_nationkey + 1)::bigint from nation join region on n_regionkey = r_regionkey
  union all select r_name, 'c' || c_custkey, c_name, 3, ['r' || r_regionkey, 'n' || n_nationkey], coalesce(k, 0)::int, (c_custkey + 1000)::bigint
    from customer left join (select o_custkey, count(*) as k from orders group by 1) o on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an agent's step log: run, seq order (ts, event_id), tool, tokens, key."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), "ts", "event_id", F.col("event_type").alias("tool"), F.col("value").alias("cost"), F.floor(F.abs("value") * 100).cast("long").alias("tokens"), F.get_json_object("props", "$.k").cast("long").alias("key"))


STEPS_SQL = """steps as (select user_id as run, ts, event_id, event_type as tool, value as cost, floor(abs(value) * 100)::bigint as tokens, (props->>'$.k')::bigint as key from events)"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows made of parts: gold value, format, dimensions and a prediction.

    The prediction departs from gold by a rule of the key, so that right, near,
    wrong and missing answers all occur.
    """
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    form = F.element_at(F.array(*map(F.lit, ("Str", "Float", "Percentage", "Bool", "None"))), (k % 5 + 1).cast("int"))
    price = F.format_string("%.2f", F.col("p_retailprice"))
    gold = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 3, F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")).when(k % 5 == 4, "Not answerable").otherwise(price)
    wrong = F.when(k % 5 == 0, F.concat(F.lit("The answer is "), F.col("p_name"), F.lit("!"))).when(k % 5 == 3, "Yes, it is").when(k % 5 == 4, "It cannot be determined.").otherwise(F.format_string("about %.2f", F.col("p_retailprice") * 1.04))
    prediction = F.when(k % 3 == 0, gold).when(k % 3 == 1, wrong).otherwise(F.concat(F.lit("none of "), F.col("p_brand")))
    return p.select(F.concat(F.lit("q"), k).alias("question_id"), F.lower("p_brand").alias("domain"), F.col("p_type").alias("reasoning_type"), form.alias("raw_format"), F.lit("").alias("verification_rule"), gold.alias("gold"), prediction.alias("prediction"), (k % 7 != 6).alias("answered"), (F.col("p_size") % 3).cast("string").alias("difficulty"))


QA_SQL = """qa as (select 'q' || p_partkey as question_id, lower(p_brand) as domain, p_type as reasoning_type,
  (['Str', 'Float', 'Percentage', 'Bool', 'None'])[p_partkey % 5 + 1] as raw_format, '' as verification_rule,
  case p_partkey % 5 when 0 then p_name when 3 then case when p_size % 2 = 0 then 'true' else 'false' end when 4 then 'Not answerable' else printf('%.2f', p_retailprice) end as gold,
  case p_partkey % 3
    when 0 then case p_partkey % 5 when 0 then p_name when 3 then case when p_size % 2 = 0 then 'true' else 'false' end when 4 then 'Not answerable' else printf('%.2f', p_retailprice) end
    when 1 then case p_partkey % 5 when 0 then 'The answer is ' || p_name || '!' when 3 then 'Yes, it is' when 4 then 'It cannot be determined.' else 'about ' || printf('%.2f', p_retailprice * 1.04) end
    else 'none of ' || p_brand end as prediction,
  p_partkey % 7 <> 6 as answered, (p_size % 3)::varchar as difficulty from part)"""
