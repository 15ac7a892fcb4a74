"""Scalar functions by family, each evaluated over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline.functions import library as lib
from harborline.operators.ordered import row_index
from harborline.plans.registry import Tables, query


@query(
    "b26_string_functions",
    """
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, p_name || '/' || p_brand AS joined,
           concat_ws('-', p_name, p_type) AS dashed, substr(p_name, 2, 3) AS part_of, trim('  ' || p_name || ' ') AS trimmed,
           replace(p_name, 'e', 'E') AS replaced, split_part(p_name, ' ', 2) AS second_word, lpad(p_brand, 12, '*') AS padded,
           rpad(p_brand, 10, '.') AS padded_right, reverse(p_name) AS reversed,
           CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance, left(p_name, 3) AS l3, right(p_name, 3) AS r3,
           repeat('ab', 2) || p_type AS repeated, CAST(strpos(p_name, 'i') AS BIGINT) AS pos,
           starts_with(p_name, 'red') AS is_red, ends_with(p_name, 't') AS ends_t, translate(p_name, 'aeiou', '12345') AS digits,
           CAST(ascii(p_name) AS BIGINT) AS first_code, chr(65 + p_size % 26) AS letter,
           CAST(length(p_name) AS BIGINT) AS chars, CAST(bit_length(p_name) AS BIGINT) AS bits
    FROM part
    """,
)
def b26_string_functions(t: Tables):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", F.upper(name).alias("up"), F.lower("p_type").alias("low"),
        F.concat(name, F.lit("/"), "p_brand").alias("joined"), F.concat_ws("-", name, "p_type").alias("dashed"),
        F.substring(name, 2, 3).alias("part_of"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.replace(name, F.lit("e"), F.lit("E")).alias("replaced"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second_word"),
        F.lpad("p_brand", 12, "*").alias("padded"), F.rpad("p_brand", 10, ".").alias("padded_right"),
        F.reverse(name).alias("reversed"), F.levenshtein(name, "p_type").cast("bigint").alias("distance"),
        F.left(name, F.lit(3)).alias("l3"), F.right(name, F.lit(3)).alias("r3"),
        F.concat(F.repeat(F.lit("ab"), 2), "p_type").alias("repeated"),
        lib.strpos(name, "i").cast("bigint").alias("pos"),
        F.startswith(name, F.lit("red")).alias("is_red"), F.endswith(name, F.lit("t")).alias("ends_t"),
        F.translate(name, "aeiou", "12345").alias("digits"), F.ascii(name).cast("bigint").alias("first_code"),
        F.char(F.lit(65) + F.col("p_size") % 26).alias("letter"),
        F.char_length(name).cast("bigint").alias("chars"), F.bit_length(name).cast("bigint").alias("bits"),
    )


@query(
    "b26_string_functions_more",
    """
    SELECT c_custkey, ltrim('  ' || c_name) AS no_left, rtrim(c_name || '  ') AS no_right, trim('C0' FROM c_name) AS no_c0,
           CAST(octet_length(encode(c_mktsegment)) AS BIGINT) AS bytes,
           upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS capitalised,
           CAST(strpos('AUTOMOBILE,BUILDING,FURNITURE', c_mktsegment) > 0 AS BOOLEAN) AS in_list,
           CAST(coalesce(list_position(string_split('AUTOMOBILE,BUILDING,FURNITURE', ','), c_mktsegment), 0) AS BIGINT) AS list_index,
           split_part(c_name, '#', 1) AS before_hash, split_part(c_name, '#', -1) AS after_hash,
           substr(c_name, 1, 8) || 'XX' || substr(c_name, 11) AS overlaid, printf('%05d', c_custkey) AS padded_key,
           lower(to_hex(c_custkey)) AS hex_key
    FROM customer
    """,
)
def b26_string_functions_more(t: Tables):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    listed = F.lit("AUTOMOBILE,BUILDING,FURNITURE")
    return t.customer.select(
        "c_custkey", F.ltrim(F.concat(F.lit("  "), name)).alias("no_left"),
        F.rtrim(F.concat(name, F.lit("  "))).alias("no_right"), F.btrim(name, F.lit("C0")).alias("no_c0"),
        F.octet_length(segment).cast("bigint").alias("bytes"), F.initcap(segment).alias("capitalised"),
        F.contains(listed, segment).alias("in_list"), F.find_in_set(segment, listed).cast("bigint").alias("list_index"),
        F.substring_index(name, "#", 1).alias("before_hash"), F.substring_index(name, "#", -1).alias("after_hash"),
        F.overlay(name, F.lit("XX"), 9, 2).alias("overlaid"), F.format_string("%05d", "c_custkey").alias("padded_key"),
        lib.to_hex(F.col("c_custkey")).alias("hex_key"),
    )


@query(
    "b26_regular_expressions",
    r"""
    SELECT page_id, regexp_matches(url, '^https://') AS secure, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
           regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_replace(url, '[0-9]+', '#') AS masked_once,
           array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers,
           CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links
    FROM pages
    """,
)
def b26_regular_expressions(t: Tables):
    return t.pages.select(
        "page_id", F.regexp_like("url", F.lit("^https://")).alias("secure"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.regexp_replace("url", "[0-9]+", "#").alias("masked"),
        lib.regexp_replace_first(F.col("url"), "[0-9]+", "#").alias("masked_once"),
        F.array_join(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0)), ",").alias("numbers"),
        F.regexp_count("html", F.lit("<a href=")).cast("bigint").alias("links"),
    )


@query(
    "b26_hash_and_encoding",
    """
    SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, lower(hex(encode(lang))) AS hex_lang,
           to_base64(encode(source)) AS b64_source, decode(from_base64(to_base64(encode(source)))) AS round_trip
    FROM documents
    """,
)
def b26_hash_and_encoding(t: Tables):
    return t.documents.select(
        "doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"),
        F.lower(F.hex("lang")).alias("hex_lang"), F.base64(F.col("source").cast("binary")).alias("b64_source"),
        F.decode(F.unbase64(F.base64(F.col("source").cast("binary"))), "UTF-8").alias("round_trip"),
    )


@query(
    "b27_date_time_functions",
    """
    SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, date_trunc('week', o_orderdate) AS week_start,
           CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q,
           CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d,
           CAST(isodow(o_orderdate) AS BIGINT) AS dow, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy,
           o_orderdate + INTERVAL 3 DAY AS plus_3d, o_orderdate - INTERVAL 2 MONTH AS minus_2m,
           CAST(datediff('day', o_orderdate, TIMESTAMP '2001-12-31') AS BIGINT) AS days_left,
           strftime(o_orderdate, '%Y/%m/%d') AS text_date, epoch_us(o_orderdate) // 1000000 AS epoch_s,
           CAST(make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) AS TIMESTAMP) AS new_year,
           CAST(last_day(o_orderdate) AS TIMESTAMP) AS month_end, dayname(o_orderdate) AS day_name
    FROM orders
    """,
)
def b27_date_time_functions(t: Tables):
    day = F.col("o_orderdate")

    def ntz(column):
        return column.cast("timestamp_ntz")

    return t.orders.select(
        "o_orderkey", ntz(F.date_trunc("month", day)).alias("month_start"), ntz(F.date_trunc("week", day)).alias("week_start"),
        F.year(day).cast("bigint").alias("y"), F.quarter(day).cast("bigint").alias("q"),
        F.month(day).cast("bigint").alias("m"), F.dayofmonth(day).cast("bigint").alias("d"),
        F.extract(F.lit("DAYOFWEEK_ISO"), day).cast("bigint").alias("dow"), F.dayofyear(day).cast("bigint").alias("doy"),
        (day + F.expr("INTERVAL 3 DAYS")).alias("plus_3d"), (day - F.expr("INTERVAL 2 MONTHS")).alias("minus_2m"),
        F.datediff(F.expr("TIMESTAMP_NTZ '2001-12-31'"), day).cast("bigint").alias("days_left"),
        F.date_format(day, "yyyy/MM/dd").alias("text_date"), F.unix_seconds(day.cast("timestamp")).alias("epoch_s"),
        ntz(F.make_date(F.year(day), F.lit(1), F.lit(1))).alias("new_year"), ntz(F.last_day(day)).alias("month_end"),
        F.date_format(day, "EEEE").alias("day_name"),
    )


@query(
    "b27_bins_and_parsing",
    """
    SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter_hour, date_trunc('hour', ts) AS hour_start,
           CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s,
           epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed,
           CAST(make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS TIMESTAMP) AS whole_second
    FROM events
    """,
)
def b27_bins_and_parsing(t: Tables):
    ts = F.col("ts")
    instant = ts.cast("timestamp")
    return t.events.select(
        "event_id", lib.date_bin(900, ts).alias("quarter_hour"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start"),
        F.hour(ts).cast("bigint").alias("h"), F.minute(ts).cast("bigint").alias("mi"), F.second(ts).cast("bigint").alias("s"),
        F.unix_micros(instant).alias("us"), F.unix_millis(instant).alias("ms"),
        F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("parsed"),
        F.timestamp_seconds(F.unix_seconds(instant)).cast("timestamp_ntz").alias("whole_second"),
    )


@query(
    "b28_math_functions",
    """
    SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, CAST(ceil(l_quantity / 7) AS BIGINT) AS c,
           CAST(floor(l_quantity / 7) AS BIGINT) AS f, round(l_extendedprice / 3, 2) AS r, round(power(l_quantity, 2), 6) AS p,
           round(ln(l_quantity + 1), 6) AS l, round(log10(l_quantity), 6) AS l10, round(log2(l_quantity), 6) AS l2,
           round(sqrt(l_quantity), 6) AS sq, round(cbrt(l_quantity), 6) AS cb, round(exp(l_discount), 6) AS e,
           round(sin(l_quantity), 6) AS sn, round(cos(l_quantity), 6) AS cs, round(tan(l_discount), 6) AS tn,
           round(atan2(l_quantity, 3), 6) AS at2, round(degrees(l_discount), 6) AS dg, round(radians(l_quantity), 6) AS rd,
           CAST(sign(l_discount - 0.05) AS BIGINT) AS sg, CAST(l_orderkey % 7 AS BIGINT) AS md,
           CAST(gcd(l_orderkey, l_partkey) AS BIGINT) AS g, CAST(lcm(l_orderkey, l_linenumber) AS BIGINT) AS lc,
           CAST(trunc(l_quantity / 7) AS BIGINT) AS tr, CAST(factorial(l_linenumber) AS BIGINT) AS fa, round(pi(), 6) AS pi,
           round(sinh(l_discount), 6) AS snh, round(cosh(l_discount), 6) AS csh, round(tanh(l_discount), 6) AS tnh,
           round(asin(l_discount), 6) AS asn, round(acos(l_discount), 6) AS acs, isnan(l_tax) AS is_nan,
           l_tax = 0 AS is_zero, round(log(l_quantity + 1) / log(3), 6) AS log3
    FROM lineitem
    """,
)
def b28_math_functions(t: Tables):
    qty, disc = F.col("l_quantity"), F.col("l_discount")

    def r6(column, name):
        return F.round(column, 6).alias(name)

    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.abs(disc - 0.05).alias("a"), F.ceil(qty / 7).alias("c"), F.floor(qty / 7).alias("f"),
        F.round(F.col("l_extendedprice") / 3, 2).alias("r"), r6(F.pow(qty, F.lit(2)), "p"), r6(F.ln(qty + 1), "l"),
        r6(F.log10(qty), "l10"), r6(F.log2(qty), "l2"), r6(F.sqrt(qty), "sq"), r6(F.cbrt(qty), "cb"), r6(F.exp(disc), "e"),
        r6(F.sin(qty), "sn"), r6(F.cos(qty), "cs"), r6(F.tan(disc), "tn"), r6(F.atan2(qty, F.lit(3.0)), "at2"),
        r6(F.degrees(disc), "dg"), r6(F.radians(qty), "rd"), F.signum(disc - 0.05).cast("bigint").alias("sg"),
        (F.col("l_orderkey") % 7).alias("md"), lib.gcd(F.col("l_orderkey"), F.col("l_partkey")).alias("g"),
        lib.lcm(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")).alias("lc"), lib.trunc(qty / 7).alias("tr"),
        F.factorial("l_linenumber").alias("fa"), r6(F.pi(), "pi"), r6(F.sinh(disc), "snh"), r6(F.cosh(disc), "csh"),
        r6(F.tanh(disc), "tnh"), r6(F.asin(disc), "asn"), r6(F.acos(disc), "acs"), F.isnan("l_tax").alias("is_nan"),
        lib.is_zero(F.col("l_tax")).alias("is_zero"), r6(F.log(3.0, qty + 1), "log3"),
    )


@query(
    "b29_array_functions",
    """
    SELECT vec_id, CAST(len(e) AS BIGINT) AS n, list_contains(e, e[3]) AS has_third,
           CAST(list_position(e, e[3]) AS BIGINT) <= 3 AS position_ok,
           round(list_sum(list_transform(e[2:5], lambda x: CAST(x AS DOUBLE))), 6) AS slice_sum,
           round(CAST(list_max(e) AS DOUBLE), 6) AS top, round(CAST(list_min(e) AS DOUBLE), 6) AS low,
           round(CAST(list_sort(e)[1] AS DOUBLE), 6) AS first_sorted, round(CAST(list_reverse(e)[1] AS DOUBLE), 6) AS last_item,
           CAST(len(list_distinct(e)) AS BIGINT) AS distinct_items, CAST(len(list_concat(e, e)) AS BIGINT) AS doubled,
           CAST(len(list_append(e, 1.0)) AS BIGINT) AS appended, CAST(len(flatten([e, e])) AS BIGINT) AS flattened,
           CAST(len(list_filter(e, lambda x: x > 0)) AS BIGINT) AS positive,
           array_to_string(list_transform(e[1:3], lambda x: CAST(CAST(floor(x * 100) AS BIGINT) AS VARCHAR)), ',') AS first_three
    FROM (SELECT vec_id, embedding AS e FROM embeddings)
    """,
)
def b29_array_functions(t: Tables):
    e = F.col("embedding")
    third = F.element_at(e, 3)

    def r6(column):
        return F.round(column.cast("double"), 6)

    total = F.aggregate(lib.array_slice_between(e, 2, 5), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return t.embeddings.select(
        "vec_id", F.size(e).cast("bigint").alias("n"), F.array_contains(e, third).alias("has_third"),
        (F.array_position(e, third) <= 3).alias("position_ok"), F.round(total, 6).alias("slice_sum"),
        r6(F.array_max(e)).alias("top"), r6(F.array_min(e)).alias("low"),
        r6(F.element_at(F.array_sort(e), 1)).alias("first_sorted"), r6(F.element_at(F.reverse(e), 1)).alias("last_item"),
        F.size(F.array_distinct(e)).cast("bigint").alias("distinct_items"), F.size(F.concat(e, e)).cast("bigint").alias("doubled"),
        F.size(F.array_append(e, F.lit(1.0).cast("float"))).cast("bigint").alias("appended"),
        F.size(F.flatten(F.array(e, e))).cast("bigint").alias("flattened"),
        F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"),
        F.array_join(F.transform(lib.array_slice_between(e, 1, 3), lambda x: F.floor(x * 100).cast("string")), ",").alias("first_three"),
    )


@query(
    "b29_array_set_functions",
    """
    SELECT p_partkey, array_to_string(string_split(p_name, ' '), '+') AS words,
           CAST(len(list_intersect(w, ['red', 'blue', 'ring'])) AS BIGINT) AS shared,
           list_has_any(w, ['red', 'ring']) AS has_any, list_has_all(w, ['small', 'ring']) AS has_all,
           array_to_string(list_prepend(p_type, w), '|') AS prefixed,
           array_to_string(list_resize(w, 3, '-'), '|') AS resized,
           CAST(len(list_distinct(list_concat(w, [p_type]))) AS BIGINT) AS unioned,
           array_to_string([CAST(x AS VARCHAR) FOR x IN range(0, p_size, 10)], ',') AS steps,
           CAST(list_sum(generate_series(1, p_size)) AS BIGINT) AS triangle,
           array_to_string(list_transform(w, lambda x: CASE WHEN x = 'red' THEN 'crimson' ELSE x END), ' ') AS recoloured
    FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
    """,
)
def b29_array_set_functions(t: Tables):
    words = F.split("p_name", " ")

    def texts(*items):
        return F.array(*[F.lit(i) for i in items])

    size = F.col("p_size")
    steps = F.transform(F.sequence(F.lit(0), F.call_function("div", size - 1, F.lit(10)).cast("int")), lambda i: (i * 10).cast("string"))
    return t.part.select(
        "p_partkey", F.array_join(words, "+").alias("words"),
        F.size(F.array_intersect(words, texts("red", "blue", "ring"))).cast("bigint").alias("shared"),
        F.arrays_overlap(words, texts("red", "ring")).alias("has_any"),
        lib.array_has_all(words, texts("small", "ring")).alias("has_all"),
        F.array_join(F.array_prepend(words, F.col("p_type")), "|").alias("prefixed"),
        F.array_join(lib.array_resize(words, 3, F.lit("-")), "|").alias("resized"),
        F.size(F.array_union(words, F.array("p_type"))).cast("bigint").alias("unioned"),
        F.array_join(steps, ",").alias("steps"),
        F.aggregate(F.sequence(F.lit(1), size), F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("triangle"),
        F.array_join(lib.array_replace_all(words, F.lit("red"), F.lit("crimson")), " ").alias("recoloured"),
    )


@query(
    "b30_map_and_struct",
    """
    SELECT event_id, map_extract(m, 'value')[1] AS value_text, array_to_string(list_sort(map_keys(m)), ',') AS keys,
           CAST(cardinality(m) AS BIGINT) AS n, s.kind AS kind, s.at.day AS day
    FROM (SELECT event_id, MAP(['type', 'user', 'value'], [event_type, CAST(user_id AS VARCHAR), CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)]) AS m,
                 {'kind': event_type, 'at': {'day': CAST(day(ts) AS BIGINT)}} AS s FROM events)
    """,
)
def b30_map_and_struct(t: Tables):
    built = t.events.select(
        "event_id",
        F.map_from_arrays(
            F.array(F.lit("type"), F.lit("user"), F.lit("value")),
            F.array("event_type", F.col("user_id").cast("string"), F.floor("value").cast("string")),
        ).alias("m"),
        F.named_struct(
            F.lit("kind"), F.col("event_type"),
            F.lit("at"), F.named_struct(F.lit("day"), F.dayofmonth("ts").cast("bigint")),
        ).alias("s"),
    )
    return built.select(
        "event_id", F.element_at("m", "value").alias("value_text"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.size("m").cast("bigint").alias("n"),
        F.col("s.kind").alias("kind"), F.col("s.at.day").alias("day"),
    )


@query(
    "b31_json_functions",
    """
    SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n,
           round(avg(value), 9) AS avg_value
    FROM events GROUP BY event_type, CAST(json_extract_string(props, '$.k') AS BIGINT)
    """,
)
def b31_json_functions(t: Tables):
    return (
        t.events.select("event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))
        .groupBy("event_type", "k")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("avg_value"))
    )


@query(
    "b31_json_round_trip",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS by_path,
           json_extract_string(props, '$.missing') IS NULL AS no_field,
           '{"id":' || event_id || ',"type":"' || event_type || '"}' AS written
    FROM events
    """,
)
def b31_json_round_trip(t: Tables):
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("by_path"),
        F.get_json_object("props", "$.missing").isNull().alias("no_field"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("written"),
    )


@query(
    "b32_conditional_and_null",
    """
    SELECT d.doc_id, coalesce(l.quality, -1) AS quality, nullif(d.lang, 'en') AS foreign_lang,
           greatest(d.n_chars, 1000) AS at_least, least(d.n_chars, 1000) AS at_most,
           CASE WHEN l.toxic IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS state,
           ifnull(l.toxic, 0) AS toxic, CASE WHEN l.quality IS NOT NULL THEN 'known' ELSE 'unknown' END AS known,
           l.quality IS NOT DISTINCT FROM l.toxic AS same, TRY_CAST(substr(d.source, 4) AS BIGINT) AS source_number,
           TRY_CAST(d.source AS BIGINT) AS not_a_number
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def b32_conditional_and_null(t: Tables):
    quality, toxic = F.col("quality"), F.col("toxic")
    return t.documents.select("doc_id", "lang", "n_chars", "source").join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce(quality, F.lit(-1)).alias("quality"), F.nullif("lang", F.lit("en")).alias("foreign_lang"),
        F.greatest("n_chars", F.lit(1000)).alias("at_least"), F.least("n_chars", F.lit(1000)).alias("at_most"),
        F.when(toxic.isNull(), "unlabelled").when(toxic == 1, "toxic").otherwise("clean").alias("state"),
        F.ifnull(toxic, F.lit(0)).alias("toxic"), F.nvl2(quality, F.lit("known"), F.lit("unknown")).alias("known"),
        quality.eqNullSafe(toxic).alias("same"),
        F.expr("substr(source, 4)").try_cast("bigint").alias("source_number"),
        F.col("source").try_cast("bigint").alias("not_a_number"),
    )


@query(
    "b11_regression_and_position_aggregates",
    """
    SELECT o_orderpriority, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept,
           round(regr_sxx(o_totalprice / 1000, o_custkey), 0) AS sxx, round(regr_sxy(o_totalprice / 1000, o_custkey), 0) AS sxy,
           round(regr_syy(o_totalprice / 1000, o_custkey), 0) AS syy, round(mean(o_totalprice), 6) AS mean_price,
           arg_min(o_orderkey, o_totalprice) AS cheapest, mode(o_orderstatus) AS usual_status,
           round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS finished,
           any_value(o_orderpriority) AS any_priority, min(o_orderdate) AS first_day,
           product(CASE WHEN o_totalprice > 0 THEN 1.0 ELSE 2.0 END) AS ones
    FROM orders GROUP BY o_orderpriority
    """,
)
def b11_regression_and_position_aggregates(t: Tables):
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(F.regr_intercept(price, key), 4).alias("intercept"),
        F.round(F.regr_sxx(price / 1000, key), 0).alias("sxx"), F.round(F.regr_sxy(price / 1000, key), 0).alias("sxy"),
        F.round(F.regr_syy(price / 1000, key), 0).alias("syy"), F.round(F.mean(price), 6).alias("mean_price"),
        F.min_by("o_orderkey", price).alias("cheapest"), F.mode("o_orderstatus").alias("usual_status"),
        F.round(F.sum(F.when(F.col("o_orderstatus") == "F", price)), 2).alias("finished"),
        F.any_value("o_orderpriority").alias("any_priority"), F.min("o_orderdate").alias("first_day"),
        F.product(F.when(price > 0, 1.0).otherwise(2.0)).alias("ones"),
    )


@query(
    "b15_nth_value_aggregate",
    """
    SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS statuses,
           list(o_orderstatus ORDER BY o_orderstatus)[2] AS second_status
    FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY o_custkey
    """,
)
def b15_nth_value_aggregate(t: Tables):
    """Over the distinct statuses of a customer; the second is found by its place, not in a list."""
    placed = row_index(t.orders.select("o_custkey", "o_orderstatus").distinct(), ["o_custkey"], ["o_orderstatus"], "place")
    status = F.col("o_orderstatus")
    return placed.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set(status)), "").alias("statuses"),
        F.max(F.when(F.col("place") == 2, status)).alias("second_status"),
    )


@query(
    "b27_epoch_conversions",
    """
    SELECT event_id, CAST(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS from_seconds,
           CAST(make_timestamp((epoch_us(ts) // 1000) * 1000) AS TIMESTAMP) AS from_millis,
           CAST(make_timestamp(epoch_us(ts)) AS TIMESTAMP) AS from_micros, strftime(ts, '%Y-%m-%d %H:%M:%S') AS formatted,
           CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_start, CAST(date_part('week', ts) AS BIGINT) AS iso_week,
           ts - INTERVAL 36 HOUR AS earlier, CAST(datediff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS day_number,
           CAST(TRY_CAST(left(CAST(ts AS VARCHAR), 10) AS DATE) AS TIMESTAMP) AS parsed_day,
           TRY_CAST(event_type AS DATE) IS NULL AS no_date
    FROM events
    """,
)
def b27_epoch_conversions(t: Tables):
    ts = F.col("ts")
    instant = ts.cast("timestamp")

    def ntz(column):
        return column.cast("timestamp_ntz")

    return t.events.select(
        "event_id", ntz(F.timestamp_seconds(F.unix_seconds(instant))).alias("from_seconds"),
        ntz(F.timestamp_millis(F.unix_millis(instant))).alias("from_millis"),
        ntz(F.timestamp_micros(F.unix_micros(instant))).alias("from_micros"),
        F.from_unixtime(F.unix_seconds(instant)).alias("formatted"), ntz(ts.cast("date")).alias("day_start"),
        F.weekofyear(ts).cast("bigint").alias("iso_week"), (ts - F.expr("INTERVAL 36 HOURS")).alias("earlier"),
        F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("bigint").alias("day_number"),
        ntz(F.to_date(F.left(ts.cast("string"), F.lit(10)))).alias("parsed_day"),
        F.col("event_type").try_cast("date").isNull().alias("no_date"),
    )


@query(
    "b28_math_functions_more",
    """
    SELECT p_partkey, round(asinh(p_retailprice), 6) AS ash, round(acosh(p_retailprice), 6) AS ach,
           round(atanh(p_size / 100), 6) AS ath, round(atan(p_size), 6) AS at, round(cot(p_size), 6) AS ct,
           p_size // 7 AS whole, p_size % 7 AS rest, p_size & 12 AS bits_and, p_size | 12 AS bits_or, xor(p_size, 12) AS bits_xor,
           p_size << 2 AS shifted, CAST(bit_count(p_size) AS BIGINT) AS ones, round(CAST(p_size AS DOUBLE) / 7, 3) AS r3,
           CASE WHEN isnan(CASE WHEN p_size > 25 THEN 'NaN'::DOUBLE ELSE p_retailprice END) THEN 0 ELSE p_retailprice END AS no_nan
    FROM part
    """,
)
def b28_math_functions_more(t: Tables):
    size, price = F.col("p_size"), F.col("p_retailprice")

    def r6(column):
        return F.round(column, 6)

    return t.part.select(
        "p_partkey", r6(F.asinh(price)).alias("ash"), r6(F.acosh(price)).alias("ach"), r6(F.atanh(size / 100)).alias("ath"),
        r6(F.atan(size)).alias("at"), r6(F.cot(size)).alias("ct"), F.call_function("div", size, F.lit(7)).cast("int").alias("whole"),
        (size % 7).alias("rest"), size.bitwiseAND(12).alias("bits_and"), size.bitwiseOR(12).alias("bits_or"),
        size.bitwiseXOR(F.lit(12)).alias("bits_xor"), F.shiftleft(size, 2).alias("shifted"),
        F.bit_count(size).cast("bigint").alias("ones"), F.round(size.cast("double") / 7, 3).alias("r3"),
        F.nanvl(F.when(size > 25, float("nan")).otherwise(price), F.lit(0.0)).alias("no_nan"),
    )


@query(
    "b29_array_edits",
    """
    SELECT doc_id, array_to_string(list_slice(w, 2, 4), ' ') AS two_to_four, CAST(len(w) AS BIGINT) AS words,
           array_to_string(list_reverse_sort(list_distinct(list_transform(w[1:5], lambda x: lower(x)))), ' ') AS sorted_down,
           array_to_string(list_concat(['<'], w[1:2], ['>']), '') AS wrapped,
           CAST(coalesce(list_position(w, 'the'), 0) AS BIGINT) AS first_the,
           CAST(len(list_filter(w, lambda x: x <> 'the')) AS BIGINT) AS without_the,
           CAST(len(list_filter(w, lambda x: x <> 'the')) + greatest(len(list_filter(w, lambda x: x = 'the')) - 1, 0) AS BIGINT) AS one_the_less,
           array_to_string(list_transform(range(3), lambda i: lang), ',') AS repeated
    FROM (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents)
    """,
)
def b29_array_edits(t: Tables):
    words = F.split("text", " ")
    the = F.lit("the")
    lowered = F.transform(lib.array_slice_between(F.col("w"), 1, 5), lambda x: F.lower(x))
    return t.documents.select("doc_id", "lang", words.alias("w")).select(
        "doc_id", F.array_join(lib.array_slice_between(F.col("w"), 2, 4), " ").alias("two_to_four"),
        F.size("w").cast("bigint").alias("words"),
        F.array_join(F.sort_array(F.array_distinct(lowered), asc=False), " ").alias("sorted_down"),
        F.array_join(F.concat(F.array(F.lit("<")), lib.array_slice_between(F.col("w"), 1, 2), F.array(F.lit(">"))), "").alias("wrapped"),
        F.array_position("w", the).cast("bigint").alias("first_the"),
        F.size(F.array_remove("w", the)).cast("bigint").alias("without_the"),
        F.size(lib.array_remove_first(F.col("w"), the)).cast("bigint").alias("one_the_less"),
        F.array_join(F.array_repeat("lang", 3), ",").alias("repeated"),
    )


@query(
    "b32_casts_and_type_names",
    """
    SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,1)) > 0 AS positive, CAST(c_custkey AS VARCHAR) AS as_text,
           CAST(c_nationkey AS BIGINT) AS as_long, CAST(c_nationkey AS DOUBLE) AS as_double, c_nationkey > 0 AS as_bool,
           TRY_CAST(c_name AS INTEGER) IS NULL AS not_int, 'bigint' AS key_type, 'double' AS balance_type
    FROM customer
    """,
)
def b32_casts_and_type_names(t: Tables):
    return t.customer.select(
        "c_custkey", (F.col("c_acctbal").cast("decimal(18,1)") > 0).alias("positive"),
        F.col("c_custkey").cast("string").alias("as_text"), F.col("c_nationkey").cast("bigint").alias("as_long"),
        F.col("c_nationkey").cast("double").alias("as_double"), F.col("c_nationkey").cast("boolean").alias("as_bool"),
        F.col("c_name").try_cast("int").isNull().alias("not_int"), F.typeof("c_custkey").alias("key_type"),
        F.typeof("c_acctbal").alias("balance_type"),
    )
