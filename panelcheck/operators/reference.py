"""Reference data: categories, registrations, translation, idempotent creation, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import any_of, case_map
from panelcheck.functions.joins import first_row


def with_category(df: DataFrame, column: str = "commodity_category") -> DataFrame:
    """Adds the registered name and rule flags of a category; unknown ids give nulls."""
    names = {c: name for c, name, _ in V.CATEGORIES}
    flags = F.create_map(*[x for c, _, fl in V.CATEGORIES for x in (F.lit(c), F.array(*[F.lit(t) for t in fl]))])
    return df.withColumn("category_name", case_map(F.col(column), names)).withColumn(
        "category_flags", F.element_at(flags, F.col(column))
    )


# ------------------------------------------------------------------ registrations


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, n)
        )
    )


def first_entity_by_name(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """query -> the first registry row whose entity name contains it.

    Names are indexed by their substrings of three letters.  A query of up to
    three letters is answered from the index alone; a longer one meets only the
    names that hold its rarest three letters and is then checked in full.
    """
    q = queries.select("query").distinct()
    names = registry.select(F.lower("entity_name").alias("name"), "registry_seq", "registration_number")
    slim = names.select("name", F.struct("registry_seq", "registration_number").alias("hit"))
    index = slim.select("hit", "name", F.explode(F.flatten(F.array(*[_grams(F.col("name"), n) for n in (1, 2, 3)]))).alias("gram"))
    best = index.groupBy("gram").agg(F.min("hit").alias("hit"), F.count(F.lit(1)).alias("names"))
    short = q.filter(F.length("query") <= 3).join(best.withColumnRenamed("gram", "query"), "query").select("query", "hit")
    long = q.filter(F.length("query") > 3)
    rarest = (
        long.select("query", F.explode(_grams(F.col("query"), 3)).alias("gram"))
        .join(best.select("gram", "names"), "gram", "left")
        .groupBy("query")
        .agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0).cast("bigint")), "gram")).alias("gram"))
    )
    found = (
        rarest.join(index.filter(F.length("gram") == 3), "gram")
        .filter(F.contains("name", "query"))
        .groupBy("query")
        .agg(F.min("hit").alias("hit"))
    )
    return short.unionByName(found)


def verify_registrations(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """By number, else by name, else NOT_FOUND.

    ``requests``: request_id, registration_number, company_name; ``registry``:
    registry_seq, registration_number, entity_name, status.
    """
    keyed = requests.withColumn("reg_key", F.upper(F.trim("registration_number")))
    by_number = first_row(registry, ["registration_number"], [F.col("registry_seq")], ["status", "entity_name"]).select(
        F.col("registration_number").alias("reg_key"), F.col("status").alias("n_status"), F.col("entity_name").alias("n_name")
    )
    direct = keyed.join(by_number, "reg_key", "left")
    open_ = direct.filter(F.col("n_status").isNull() & (F.coalesce("company_name", F.lit("")) != ""))
    asked = open_.select(F.trim(F.lower("company_name")).alias("query"))
    named = first_entity_by_name(asked, registry).select("query", F.col("hit.registration_number").alias("found_number"))
    facts = by_number.select(
        F.col("reg_key").alias("found_number"), F.col("n_status").alias("f_status"), F.col("n_name").alias("f_name")
    )
    query = F.when(F.col("n_status").isNull() & (F.coalesce("company_name", F.lit("")) != ""), F.trim(F.lower("company_name")))
    rows = direct.withColumn("query", query).join(named.join(facts, "found_number"), "query", "left")
    status = F.coalesce("n_status", "f_status", F.lit("NOT_FOUND"))
    return rows.select(
        "request_id",
        F.coalesce("found_number", "reg_key").alias("registration_number"),
        status.alias("status"),
        F.coalesce("n_name", "f_name").alias("entity_name"),
        status.isin(*V.REGISTERED_STATUSES).alias("is_registered"),
    )


# ------------------------------------------------------------------ translation


def _term(words: list[str], lang: str) -> str | None:
    return words[V.TERM_LANGUAGES.index(lang)] if lang in V.TERM_LANGUAGES else None


def translate(text: Column, lang: str) -> Column:
    """Two phrase rules, then field terms in order, then two country names, else the trimmed text."""
    clean = F.trim(text)
    low = F.lower(clean)
    has = lambda w: F.contains(low, F.lit(w))
    rules = [
        (has("exceeds") & has("mrp"), _term(V.PHRASES["mrp_inflation"], lang)),
        (has("quantity") & (has("mismatch") | has("conflict")), _term(V.PHRASES["net_quantity_mismatch"], lang)),
    ]
    rules += [(any_of([has(k), has(k.replace("_", " "))]), _term(words, lang)) for k, words in V.TERMS.items()]
    rules += [(low == country, names.get(lang)) for country, names in V.COUNTRIES.items()]
    out = None
    for cond, word in rules:
        out = (F.when if out is None else out.when)(cond, clean if word is None else F.lit(word))
    return out.otherwise(clean)


def term_label(field_type: Column, lang: str) -> Column:
    known = {k: _term(words, lang) for k, words in V.TERMS.items() if _term(words, lang)}
    plain = F.initcap(F.replace(field_type, F.lit("_"), F.lit(" ")))
    return case_map(field_type, known, plain) if known else plain


def translate_fields(fields: DataFrame, lang: str) -> DataFrame:
    value = F.coalesce(F.nullif("parsed_value", F.lit("")), F.nullif("raw_text", F.lit("")), F.lit(""))
    done = translate(value, lang)
    return fields.select(
        "inspection_id", F.col("id").alias("field_id"), "field_type", term_label(F.col("field_type"), lang).alias("label"),
        value.alias("original_value"), F.when(done == "", value).otherwise(done).alias("translated_value"),
    )


def translate_violations(violations: DataFrame, lang: str) -> DataFrame:
    done = translate(F.col("description"), lang)
    return violations.select(
        "inspection_id", F.col("id").alias("violation_id"), "rule_id", "severity",
        F.col("description").alias("original_description"),
        F.when(done == "", F.col("description")).otherwise(done).alias("translated_description"),
    )


def narration(inspections: DataFrame, fields: DataFrame, violations: DataFrame, lang: str = "hi") -> DataFrame:
    """One spoken summary per inspection with counts and the first violation."""
    n_fields = fields.groupBy("inspection_id").agg(F.count(F.lit(1)).alias("declarations"))
    first = violations.groupBy("inspection_id").agg(
        F.count(F.lit(1)).alias("found"), F.min_by("description", "id").alias("first")
    )
    zero = F.lit(0).cast("bigint")
    rows = (
        inspections.select(F.col("id").alias("inspection_id"))
        .join(n_fields, "inspection_id", "left").join(first, "inspection_id", "left")
        .select("inspection_id", "first", *[F.coalesce(c, zero).alias(c) for c in ("declarations", "found")])
    )
    clean = F.col("found") == 0
    if lang in V.NARRATION:
        good, bad = V.NARRATION[lang]
        text = F.when(clean, F.format_string(good, "declarations")).otherwise(
            F.format_string(bad, "found", translate(F.col("first"), lang))
        )
    else:
        ok = _term(V.PHRASES["pass"], lang) or V.NARRATION_STATUS_OTHER[0]
        bad = _term(V.PHRASES["violation_detected"], lang) or V.NARRATION_STATUS_OTHER[1]
        name = V.LANGUAGES.get(lang, V.LANGUAGES["hi"])
        text = F.format_string(
            V.NARRATION_OTHER, F.lit(name), "declarations", "found", F.when(clean, ok).otherwise(bad)
        )
    return rows.select("inspection_id", text.alias("summary_narration"))


# ------------------------------------------------------------------ creation


def idempotent_create(requests: DataFrame, existing: DataFrame, active_version: Column) -> DataFrame:
    """One row per request: created, or reused with the id that already holds its key.

    The key is (officer_id, client_id); a request without client id always
    creates.  Within a batch the first request by ``request_seq`` wins.  The
    active pack version is frozen into what is created.
    """
    key = ["officer_id", "client_id"]
    known = first_row(existing.filter("client_id IS NOT NULL"), key, [F.col("id")], ["id"]).withColumnRenamed("id", "existing_id")
    # first_row combines on the map side, so a key repeated by a broken device stays small
    winner = requests.filter("client_id IS NOT NULL").groupBy(*key).agg(F.min("request_seq").alias("winner_seq"))
    rows = requests.join(winner, key, "left").join(known, key, "left")
    status = F.when(F.col("captured_offline"), "sync_pending").otherwise("draft")
    made = F.col("existing_id").isNull() & (F.col("winner_seq").isNull() | (F.col("winner_seq") == F.col("request_seq")))
    return rows.select(
        "request_seq", *key,
        F.when(made, "created").otherwise("reused").alias("outcome"),
        F.when(made, F.col("request_seq")).otherwise(F.coalesce("existing_id", "winner_seq")).alias("inspection_id"),
        F.when(made, status).alias("status"),
        F.when(made, active_version).alias("rule_pack_version"),
    )


def normalize_path(path: Column) -> Column:
    """Identifiers in a URL path become {id}, so that metrics stay few."""
    p = F.regexp_replace(path, V.PATH_UUID_CASED, "{id}")
    p = F.regexp_replace(p, V.PATH_PREFIXED_CASED, "{id}")
    return F.regexp_replace(p, V.PATH_NUMBER_CASED, "/{id}")
