"""Relational bookkeeping: filtered pages, soft deletion, many-to-many roles, upserts, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rag import violations


def alive(df: DataFrame, column: str = "is_deleted") -> DataFrame:
    """Rows whose flag is false; a missing flag is neither."""
    return df.where(F.col(column).eqNullSafe(F.lit(False)))


def same_name(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.strip().lower()


def same_code(column: str, value: str) -> Column:
    return F.col(column) == value.strip()


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page with the total over all pages: the count joins in as one row, and the top of the order is no full sort."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(skip).limit(limit).crossJoin(F.broadcast(total))


def sort_column(name: str, descending: bool, allowed: tuple[str, ...]) -> Column:
    if name not in allowed:
        raise ValueError(f"cannot sort by {name}")
    return F.col(name).desc() if descending else F.col(name).asc()


def page_numbers(total: Column, skip: Column, limit: Column) -> Column:
    """Current page, pages, first and last item shown, counted from one."""
    return F.struct(
        (F.floor(skip / limit) + 1).alias("current_page"),
        F.greatest(F.lit(1), F.ceil(total / limit)).alias("total_pages"),
        F.when(total == 0, F.lit(0)).otherwise(skip + 1).alias("start_item"),
        F.least(total, skip + limit).alias("end_item"),
    )


def exists(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def missing(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def insert_if_absent(df: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``df`` with the rows of ``new`` whose key it lacks; of several with one key the one of the least hash."""
    first = first_of(new.select(*df.columns), list(key), [F.xxhash64(*df.columns), *[F.col(c) for c in df.columns]])
    return df.unionByName(missing(first, df, *key))


def soft_delete(df: DataFrame, condition: Column, at: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumn("deleted_at", F.when(hit & ~F.col("is_deleted"), at).otherwise(F.col("deleted_at"))).withColumn("is_deleted", F.col("is_deleted") | hit)


def cascade(parents_gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return children.join(parents_gone.select(key), key, "left_anti")


def user_permissions(users: DataFrame, user_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, permissions: DataFrame) -> DataFrame:
    """user_id with sorted role names and distinct permission codes of roles that are not deleted.

    Keys are (user_id, role_id), (role_id, name, is_deleted), (role_id, permission_id), (permission_id, code).
    Codes are gathered per role first, so the fan-out of a user is its roles and not its permissions.
    """
    per_role = role_permissions.join(permissions, "permission_id").groupBy("role_id").agg(F.collect_set("code").alias("codes"))
    active = alive(roles).select("role_id", "name").join(per_role, "role_id", "left")
    held = user_roles.join(active, "role_id").groupBy("user_id").agg(F.array_sort(F.collect_set("name")).alias("role_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("codes", F.array().cast("array<string>")))))).alias("permission_codes"))
    none = F.array().cast("array<string>")
    return users.join(held, "user_id", "left").withColumn("role_names", F.coalesce("role_names", none)).withColumn("permission_codes", F.coalesce("permission_codes", none))


def may(permission: str) -> Column:
    """Whether a user holds a permission; superusers hold all, and where there is no user nothing is held."""
    return F.coalesce(F.col("is_superuser"), F.lit(False)) | F.coalesce(F.array_contains("permission_codes", permission), F.lit(False))


def has_role(role: str) -> Column:
    """Whether a user is in a role, by its exact name; superusers are in all."""
    return F.coalesce(F.col("is_superuser"), F.lit(False)) | F.coalesce(F.array_contains("role_names", role), F.lit(False))


def system_roles(roles: DataFrame) -> DataFrame:
    """Roles of the system that are not deleted, by name."""
    return alive(roles).where("is_system").orderBy("name")


def assign(pairs: DataFrame, more: DataFrame) -> DataFrame:
    return pairs.unionByName(more).dropDuplicates()


def withdraw(pairs: DataFrame, less: DataFrame) -> DataFrame:
    return pairs.join(less, pairs.columns, "left_anti")


def password_violations(c: Column, least: int = 12) -> Column:
    return violations(
        ("too_short", F.length(c) < least),
        ("no_upper", ~c.rlike("[A-Z]")),
        ("no_lower", ~c.rlike("[a-z]")),
        ("no_digit", ~c.rlike("[0-9]")),
        ("no_sign", ~c.rlike("[^A-Za-z0-9]")),
    )


def range_violations(**bounds: tuple[float | None, float | None]) -> Column:
    """``column=(low, high)``: names of the columns outside their bounds."""
    rules = []
    for name, (low, high) in bounds.items():
        bad = F.lit(False)
        bad = bad | (F.col(name) < low) if low is not None else bad
        bad = bad | (F.col(name) > high) if high is not None else bad
        rules.append((name, F.coalesce(bad, F.lit(False))))
    return violations(*rules)


def split_rejects(df: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without violations, and the others with their codes."""
    marked = df.withColumn("error_codes", found)
    return marked.where(F.size("error_codes") == 0).drop("error_codes"), marked.where(F.size("error_codes") > 0)


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Missing counts and checksums from the text."""
    return chunks.withColumn("character_count", F.coalesce("character_count", F.length("text"))).withColumn("checksum", F.coalesce("checksum", F.sha2(F.col("text").cast("binary"), 256)))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def permissions_of(permissions: DataFrame, resource: str) -> DataFrame:
    """Permissions of one resource, by code."""
    return permissions.where(F.col("resource") == resource.strip().lower()).orderBy("code")


def contains(column: str, words: str) -> Column:
    """Whether a column holds ``words``, whatever the case; signs of patterns stand for themselves."""
    return F.contains(F.lower(F.col(column)), F.lit(words.strip().lower()))


def toggled(df: DataFrame, include_deleted: bool = False, is_active: bool | None = None, query: str | None = None, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows under those filters that are set; ``query`` must be in one of the columns."""
    out = df if include_deleted else alive(df)
    out = out if is_active is None else out.where(F.col("is_active") == is_active)
    return out.where(reduce(lambda a, b: a | b, [contains(c, query) for c in columns])) if query and query.strip() else out


def document_list(documents: DataFrame, category: str | None = None, statuses: tuple[str, ...] = (), search: str | None = None) -> DataFrame:
    """Documents of a category, in one of the statuses, with a text in their title; a filter that is not set keeps all."""
    out = documents if category is None else documents.where(F.col("category") == category)
    out = out.where(F.col("status").isin(*statuses)) if statuses else out
    return out.where(contains("title", search)) if search and search.strip() else out


def is_active_user() -> Column:
    return F.coalesce(F.col("is_active") & ~F.col("is_deleted"), F.lit(False))


def shown(users: DataFrame, *more: str) -> DataFrame:
    """What others may see of users: never a password's hash, whatever else the table holds."""
    names = ["id", "email", "full_name", "is_active", "is_verified", "is_superuser", *more, "created_at", "last_login_at"]
    if "hashed_password" in names:
        raise ValueError("hashed_password is never shown")
    return users.select(*names)


def overridden(options: dict | None, **forced: object) -> dict:
    """Options of which the forced ones count whatever was given."""
    return {**(options or {}), **forced}


def chunks_of(chunks: DataFrame, document_id: object) -> DataFrame:
    """Chunks of a document in order; the filter reaches the scan."""
    return chunks.where(F.col("document_id") == F.lit(document_id)).orderBy("chunk_index")


def with_document(chunks: DataFrame, documents: DataFrame, *columns: str) -> DataFrame:
    """Chunks with columns of their document; a chunk without one keeps nulls."""
    return chunks.join(documents.select("document_id", *columns), "document_id", "left")


def embedding_totals(batches: DataFrame) -> DataFrame:
    """One row over batches (texts, embedded, latency_ms): totals and texts per second."""
    totals = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("texts", "total_texts"), ("embedded", "successful_embeddings"), ("latency_ms", "latency_ms"))])
    return totals.withColumn("throughput_texts_per_sec", F.when(F.col("latency_ms") > 0, F.col("total_texts") * 1000 / F.col("latency_ms")).otherwise(F.lit(0.0)))


STAGES = ("parsing", "cleaning", "chunking", "embedding", "vector_upload", "database")


def ingestion_totals(reports: DataFrame) -> DataFrame:
    """One row over reports (status, total_chunks, total_vectors_stored, token_count, a duration per stage): counts, sums and time per stage."""
    stages = [F.coalesce(F.sum(f"{s}_duration_ms"), F.lit(0.0)).alias(f"{s}_duration_ms") for s in STAGES]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_chunks", "total_vectors_stored", "token_count")]
    found = reports.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), *sums, *stages)
    return found.withColumn("total_duration_ms", sum((F.col(f"{s}_duration_ms") for s in STAGES), F.lit(0.0)))


def seed_counts(**tables: DataFrame) -> DataFrame:
    """One row with the rows of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias(f"{name}_count")) for name, t in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)
