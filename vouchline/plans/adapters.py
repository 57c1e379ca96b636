"""The engine's input tables as views over the driver tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view -> (table, Spark SQL, DuckDB SQL or None where the same text holds in both)
VIEWS: dict[str, tuple[str, str, str | None]] = {
    "v_match": (
        "lineitem",
        """SELECT l_orderkey AS subject_id, CAST(l_suppkey % 3 AS INT) AS model_ord, l_partkey AS feature_id, l_linenumber AS feature_ord, l_suppkey AS tie,
             l_returnflag <> 'A' AS success, CAST(l_quantity AS INT) AS inliers, l_discount * 10 AS inlier_ratio, l_tax AS quad_area_ratio, CAST(0 AS DOUBLE) AS confidence_mean FROM lineitem""",
        None,
    ),
    "v_vote": (
        "lineitem",
        """SELECT l_orderkey AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS model_ord,
             l_quantity >= 25 AS passed, l_discount AS distance FROM lineitem""",
        None,
    ),
    "v_id14": (
        "orders",
        """SELECT o_orderkey AS case_id, concat(CAST(2 + o_orderkey % 2 AS STRING), date_format(o_orderdate, 'yyMMdd'), lpad(CAST(o_orderkey AS STRING), 7, '0')) AS id14,
             date_format(o_orderdate, 'yyyy-MM-dd') AS day, o_orderstatus AS status, CAST(o_custkey AS BIGINT) AS cust FROM orders""",
        """SELECT o_orderkey AS case_id, concat((2 + o_orderkey % 2)::VARCHAR, strftime(o_orderdate, '%y%m%d'), lpad(o_orderkey::VARCHAR, 7, '0')) AS id14,
             strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, o_custkey::BIGINT AS cust FROM orders""",
    ),
    "v_live": (
        "events",
        """SELECT event_id, user_id, event_type, event_type <> 'error' AS is_real, CAST(get_json_object(props, '$.k') AS INT) / 100.0D AS antispoof_score, value AS area FROM events""",
        """SELECT event_id, user_id, event_type, event_type <> 'error' AS is_real, CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS antispoof_score, value AS area FROM events""",
    ),
    "v_emb": (
        "embeddings",
        "SELECT vec_id, label, transform(embedding, x -> double(x)) AS e FROM embeddings",
        "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings",
    ),
    "v_box": (
        "lineitem",
        """SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS image_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS tie, CAST(l_partkey % 900 AS INT) AS x1, CAST(l_suppkey * 7 % 560 AS INT) AS y1,
             CAST(l_partkey % 900 + l_quantity AS INT) AS x2, CAST(l_suppkey * 7 % 560 + l_linenumber * 4 AS INT) AS y2, l_discount * 10 AS conf FROM lineitem""",
        None,
    ),
    "v_quad": (  # a skewed four-point outline of each line, corners in no particular order
        "lineitem",
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS tie, CAST(l_partkey % 300 AS DOUBLE) AS px, CAST(l_suppkey * 3 % 200 AS DOUBLE) AS py,
             CAST(l_quantity * 12 AS DOUBLE) AS pw, CAST(l_quantity * 8 - l_linenumber AS DOUBLE) AS ph, CAST(l_linenumber AS DOUBLE) AS sk, l_discount * 10 AS r, l_tax AS t FROM lineitem""",
        None,
    ),
    "v_lines": (
        "documents",
        "SELECT doc_id, pos, line FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM documents) WHERE trim(line) <> ''",
        "SELECT doc_id, (i - 1)::INT AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(l[i]) <> ''",
    ),
    "v_raster": (  # a bright, sheared card with its own noise on a dark ground; images of twelve sizes, one a supplier
        "supplier",
        """SELECT image, w, h, shear, x0, y0, cw, ch, transform(sequence(0, w * h - 1), i -> IF(i % w - x0 - (i DIV w - y0) * shear DIV 8 BETWEEN 0 AND cw - 1 AND i DIV w - y0 BETWEEN 0 AND ch - 1, 190, 40) + (i * 7919 + image * 31) * (i % 13 + 1) % 17) AS v FROM
             (SELECT /*+ REPARTITION(s_suppkey) */ CAST(s_suppkey AS INT) AS image, CAST(48 + s_suppkey % 3 * 8 AS INT) AS w, CAST(36 + s_suppkey % 4 * 4 AS INT) AS h, CAST(s_suppkey % 3 - 1 AS INT) AS shear, CAST(9 + s_suppkey % 5 AS INT) AS x0, CAST(6 + s_suppkey % 4 AS INT) AS y0,
               CAST(30 + s_suppkey % 3 * 6 AS INT) AS cw, CAST(20 + s_suppkey % 4 * 3 AS INT) AS ch FROM supplier)""",
        """SELECT image, w, h, shear, x0, y0, cw, ch, list_transform(range(w * h), lambda i: (CASE WHEN i % w - x0 - ((i // w - y0) * shear // 8) BETWEEN 0 AND cw - 1 AND i // w - y0 BETWEEN 0 AND ch - 1 THEN 190 ELSE 40 END + (i * 7919 + image * 31) * (i % 13 + 1) % 17)::INT) AS v FROM
             (SELECT s_suppkey::INT AS image, (48 + s_suppkey % 3 * 8)::INT AS w, (36 + s_suppkey % 4 * 4)::INT AS h, (s_suppkey % 3 - 1)::INT AS shear, (9 + s_suppkey % 5)::INT AS x0, (6 + s_suppkey % 4)::INT AS y0,
               (30 + s_suppkey % 3 * 6)::INT AS cw, (20 + s_suppkey % 4 * 3)::INT AS ch FROM supplier)""",
    ),
    "v_stage": (
        "orders",
        """SELECT o_orderkey AS case_id, o_orderkey % 17 <> 0 AS has_front, o_orderkey % 19 <> 0 AS has_back, o_orderkey % 23 <> 0 AS has_selfie, o_orderkey % 29 = 0 AS feature_error, o_orderkey % 5 <> 0 AS feature_front,
             o_custkey % 7 <> 0 AS feature_back, o_custkey % 13 = 0 AS align_error, o_custkey % 11 <> 0 AS photo_present, o_custkey % 31 = 0 AS face_error, o_orderkey % 3 <> 0 AS face_passed, o_orderkey % 37 = 0 AS ocr_error,
             CAST(10 + o_custkey % 5 AS INT) AS id_digits, o_orderkey % 41 = 0 AS liveness_error, o_custkey % 2 = 0 AS liveness_passed FROM orders""",
        None,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql, _ = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # a few numbers a row become whole arrays behind the shuffle: by its bytes alone it would end up as one task
    sql = sql.replace("REPARTITION(", f"REPARTITION({4 * spark.sparkContext.defaultParallelism}, ")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=source)


def cte(*names: str) -> str:
    """WITH clause of the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][2] or VIEWS[n][1]})" for n in names)
