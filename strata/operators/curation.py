"""Curation on append-only logs (survey K01-K03, K08-K12, K14, K16-K22).

Edits are DataFrames appended to log tables; validation, idempotency,
inheritance and lifecycle rules are joins against the current state, so a
batch of many edits is one Spark job.  Nothing rewrites history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import LEGACY_HIDDEN_PROSE, LEGACY_VISIBLE_PROSE, slug
from strata.operators.dedup import first_seen, latest_wins
from strata.operators.ordered import last_before, ordered_columns
from strata.session import cut_lineage


def stamp_edits(edits: DataFrame, author: str, server_ts: dt.datetime, id_col: str = "change_id") -> DataFrame:
    """Author and server time on each edit; a missing change id gets a
    deterministic one derived from the edit's content."""
    cid = F.coalesce(F.col(id_col), F.substring(F.sha2(F.to_json(F.struct(*[c for c in edits.columns if c != id_col])), 256), 1, 16)) \
        if id_col in edits.columns else F.substring(F.sha2(F.to_json(F.struct(*edits.columns)), 256), 1, 16)
    return edits.withColumn(id_col, cid).withColumn("edited_by", F.lit(author)).withColumn(
        "edited_at", F.lit(server_ts).cast("timestamp_ntz"))


def idempotent_intake(log: DataFrame, incoming: DataFrame, keys: Sequence[str], id_col: str = "change_id",
                      order: Sequence[str] = ("edited_at",)) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts).

    A change id already in the log is a no-op; within the batch the first
    delivery wins; a change id reused for a different key is a conflict."""
    first = first_seen(incoming, id_col, list(order))
    seen = log.select(F.col(id_col).alias("_log_id"), *[F.col(k).alias(f"_log_{k}") for k in keys])
    accepted = first.join(seen.select(F.col("_log_id").alias(id_col)).distinct(), id_col, "left_anti")
    differs = None
    for k in keys:
        c = ~F.col(k).eqNullSafe(F.col(f"_log_{k}"))
        differs = c if differs is None else differs | c
    conflicts = first.join(seen, (F.col(id_col) == F.col("_log_id")) & differs, "left_semi")
    return accepted, conflicts


# Sources of the catalogue, the vocabularies of its axes, the longest code.
SOURCES = ("pevs", "pam", "ppm", "comex", "comtrade")
INGESTION_VALUES = ("ativa", "pausada")
VISIBILITY_VALUES = ("visivel", "oculto")
MAX_CODE_LEN = 32


def validate_catalog_edits(edits: DataFrame, code: str = "codigo_produto", source: str = "banco", ingestion: str = "ingestao",
                           visibility: str = "visibilidade", lifecycle: str = "ciclo_de_vida") -> DataFrame:
    """Each edit with the first rule it breaks (``rejected``; NULL: none).

    A key is needed; a code is digits alone, 32 at most; the source is one of
    the catalogue's; ingestion, visibility and the retired lifecycle prose are of
    their vocabularies, or absent.  An unknown word would read as visible, so it
    is refused rather than stored."""
    c, s = F.coalesce(F.trim(code), F.lit("")), F.coalesce(F.trim(source), F.lit(""))
    known = lambda col, values: F.col(col).isNull() | F.col(col).isin(*values)
    return edits.withColumns({code: c, source: s}).withColumn("rejected", F.when((F.col(code) == "") | (F.col(source) == ""), "key_missing")
        .when(F.length(code) > MAX_CODE_LEN, "code_too_long")
        .when(~F.col(code).rlike(r"\A[0-9]+\z"), "code_not_digits")
        .when(~F.col(source).isin(*SOURCES), "unknown_source")
        .when(~known(ingestion, INGESTION_VALUES), "unknown_ingestion")
        .when(~known(visibility, VISIBILITY_VALUES), "unknown_visibility")
        .when((F.col(lifecycle) != "") & ~known(lifecycle, (LEGACY_VISIBLE_PROSE, LEGACY_HIDDEN_PROSE)), "unknown_lifecycle"))


def catalog_upsert(log: DataFrame, incoming: DataFrame, keys: Sequence[str], attrs: Sequence[str],
                   ts: str = "edited_at", tiebreak: str = "change_id", active: str = "active") -> DataFrame:
    """Rows to append.  NULL attributes inherit the key's current row,
    unless the key's latest edit is a tombstone (a re-add starts fresh)."""
    cur = latest_wins(log, list(keys), [ts, tiebreak]).filter(F.col(active)).select(
        *keys, *[F.col(a).alias(f"_cur_{a}") for a in attrs])
    j = incoming.join(cur, list(keys), "left")
    for a in attrs:
        j = j.withColumn(a, F.coalesce(F.col(a), F.col(f"_cur_{a}")))
    return j.drop(*[f"_cur_{a}" for a in attrs]).withColumn(active, F.lit(True))


def tombstones(current: DataFrame, keys: Sequence[str], active: str = "active") -> DataFrame:
    """One ``active = false`` edit per removed key (attributes carried)."""
    return current.withColumn(active, F.lit(False))


def group_guards(groups: DataFrame, members: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate create / rename / delete requests of groups.

    ``requests``: (op, group_id, group_name[, seq]).  Rules: a create without an
    id gets the slug of its name, which must not be empty, nor an active
    group's; of the creates of one id in a batch the first by ``seq`` stands; a
    name must be unique among active groups; rename/delete need an existing
    group; delete needs a group without active members.  Requests are judged on
    the groups before the batch.  Returns (accepted, rejected with reason).
    """
    seq = "seq" in requests.columns
    made = F.when(F.col("op") == "create", F.coalesce("group_id", F.nullif(slug("group_name"), F.lit("")))).otherwise(F.col("group_id"))
    requests = requests.withColumn("group_id", made)
    if seq:
        w = Window.partitionBy("op", "group_id").orderBy("seq")
        requests = requests.withColumn("_again", (F.col("op") == "create") & F.col("group_id").isNotNull() & (F.row_number().over(w) > 1))
    else:
        requests = requests.withColumn("_again", F.lit(False))
    names = groups.filter("active").select(F.lower(F.trim("group_name")).alias("_n"), F.col("group_id").alias("_owner"))
    exists = groups.filter("active").select(F.col("group_id").alias("_gid"))
    counts = members.groupBy(F.col("group_id").alias("_mg")).agg(F.count(F.lit(1)).alias("_members"))
    r = (requests.join(names, F.lower(F.trim("group_name")) == F.col("_n"), "left")
         .join(exists, F.col("group_id") == F.col("_gid"), "left")
         .join(counts, F.col("group_id") == F.col("_mg"), "left"))
    reason = (
        F.when((F.col("op") == "create") & F.col("group_id").isNull(), "no_id")
        .when((F.col("op") == "create") & (F.col("_gid").isNotNull() | F.col("_again")), "exists")
        .when(F.col("op").isin("create", "rename") & F.col("_n").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("group_id")),
               "name_taken")
        .when(F.col("op").isin("rename", "delete") & F.col("_gid").isNull(), "not_found")
        .when((F.col("op") == "delete") & (F.coalesce(F.col("_members"), F.lit(0)) > 0), "has_members")
    )
    r = r.withColumn("reason", reason).drop("_n", "_owner", "_gid", "_mg", "_members", "_again")
    return r.filter(F.col("reason").isNull()).drop("reason"), r.filter(F.col("reason").isNotNull())


# Fixed value: the longest name of a group.
MAX_NAME_LEN = 2000


def replay_group_requests(groups: DataFrame, members: DataFrame, requests: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """The requests in their order, each with the rule it breaks (``reason``; NULL: accepted).

    ``groups``: group_id, group_name, active; ``members``: the active members'
    group_id; ``requests``: seq, op (create, rename, delete), group_id,
    group_name, change_id; ``log``: change_id, group_id, active of earlier
    edits.  Every request meets the state that the accepted ones before it
    leave: a name freed in the batch can be taken, a deleted group made again,
    of two creates the first stands.  A create without an id gets its name's
    slug.  A change id that an accepted request had is a no-op ('repeated'), or
    a conflict if it was for another group or another end state; a refused
    request's may be used again.  Names are compared without case and outer
    blanks and are unique among the active groups before the batch.  Rows of one
    ``seq`` go by op, id, name and change id.

    The decisions are a fixed point: with a guess of which requests are
    accepted, ordered last values give each group's state and each name's
    holder before every request, and these the next guess.  Each decision
    depends on earlier requests alone, so the fixed point is the sequential
    result, and a round settles at least one more request; in practice a few
    rounds settle all.  No group and no name is held in one task.
    """
    name, op = F.trim("group_name"), F.col("op")
    naming = op.isin("create", "rename")
    given = F.nullif(F.trim("group_id"), F.lit(""))
    r = requests.select("seq", "op", "group_id", "group_name", "change_id").withColumns({
        "_all": F.lit(0), "_key": F.when(naming, F.lower(name)),
        "_gid": F.when(naming, F.coalesce(given, F.nullif(slug(name), F.lit("")))).otherwise(given)})
    order = ["seq", "op", "_gid", "_key", "change_id"]
    r = ordered_columns(r, ["_all"], order, row_number="_at").drop("_all")
    fault = (F.when(~F.coalesce(op.isin("create", "rename", "delete"), F.lit(False)), "unknown_op")
             .when(naming & (F.coalesce(name, F.lit("")) == ""), "name_missing")
             .when(naming & (F.length(name) > MAX_NAME_LEN), "name_too_long")
             .when(F.col("_gid").isNull(), "no_id"))
    held = members.groupBy(F.col("group_id").alias("_gid")).agg(F.count(F.lit(1)).alias("_members"))
    r = r.withColumn("_fault", fault).join(held, "_gid", "left")
    if log is not None:
        seen = log.groupBy("change_id").agg(F.max(F.struct(F.col("group_id").alias("g"), F.col("active").alias("a"))).alias("_logged"))
        r = r.join(seen, "change_id", "left")
    else:
        r = r.withColumn("_logged", F.lit(None).cast("struct<g:string,a:boolean>"))
    state = cut_lineage(r.withColumn("_ok", F.col("_fault").isNull()))
    before = groups.filter("active").select(F.trim("group_id").alias("_gid"), F.lower(F.trim("group_name")).alias("_key"))
    ok = F.col("_ok")
    while True:
        life = F.when(ok & (op == "create"), F.struct(F.lit(True).alias("x"))).when(ok & (op == "delete"), F.struct(F.lit(False).alias("x")))
        rows = state.withColumns({"_life": life, "_named": F.when(ok & naming, F.struct(F.col("_key").alias("x")))})
        start = before.withColumns({"_at": F.lit(0), "_life": F.struct(F.lit(True).alias("x")), "_named": F.struct(F.col("_key").alias("x"))})
        s = last_before(rows.unionByName(start, allowMissingColumns=True), ["_gid"], ["_at"], {"_was": "_life", "_had": "_named"}).filter("_at > 0")
        s = s.withColumn("_active", F.coalesce(F.col("_was")["x"], F.lit(False))).withColumn("_old", F.when(F.col("_active"), F.col("_had")["x"]))
        # a name's events: asked for (0), let go (1), taken (2)
        holder = lambda who: F.struct(who.alias("g"))
        nobody, me = holder(F.lit(None).cast("string")), holder(F.col("_gid"))
        event = lambda when, kind, key, who: F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("name"), who.alias("holder")))
        events = F.array(event(naming & F.col("_key").isNotNull(), 0, F.col("_key"), F.lit(None).cast("struct<g:string>")),
                         event(ok & F.col("_old").isNotNull(), 1, F.col("_old"), nobody), event(ok & naming, 2, F.col("_key"), me))
        e = s.select("_at", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e")).select("_at", "e.*")
        e = e.unionByName(before.select(F.lit(0).alias("_at"), F.lit(2).alias("kind"), F.col("_key").alias("name"), me.alias("holder")))
        e = last_before(e, ["name"], ["_at", "kind"], {"_by": "holder"}).filter("kind = 0 AND _at > 0").select("_at", "_by")
        ids = state.filter("change_id IS NOT NULL").select("_at", "change_id", F.when(ok, F.struct(F.col("_gid").alias("g"), (op != "delete").alias("a"))).alias("_done"))
        ids = last_before(ids, ["change_id"], ["_at"], {"_earlier": "_done"}).select("_at", "_earlier")
        s = s.join(e, "_at", "left").join(ids, "_at", "left")
        known = F.coalesce("_logged", "_earlier")
        same = known["g"].eqNullSafe(F.col("_gid")) & known["a"].eqNullSafe(op != "delete")
        holder_id = F.col("_by")["g"]
        reason = (F.when(F.col("_fault").isNotNull(), F.col("_fault"))
                  .when(known.isNotNull(), F.when(same, "repeated").otherwise("change_id_conflict"))
                  .when((op == "create") & F.col("_active"), "exists")
                  .when((op != "create") & ~F.col("_active"), "not_found")
                  .when(naming & holder_id.isNotNull() & (holder_id != F.col("_gid")), "name_taken")
                  .when((op == "delete") & (F.col("_members") > 0), "has_members"))
        s = s.withColumn("reason", reason).withColumn("_next", F.col("reason").isNull())
        s = cut_lineage(s.select(*[c for c in state.columns if c != "reason"], "reason", "_next"))
        settled = s.filter(~F.col("_ok").eqNullSafe(F.col("_next"))).isEmpty()
        state = s.withColumn("_ok", F.col("_next")).drop("_next")
        if settled:
            return state.select("seq", "op", F.col("_gid").alias("group_id"), "group_name", "change_id", "reason")


def rename_restamp(current_members: DataFrame, renamed: DataFrame, group_col: str = "group_id",
                   name_col: str = "group_name") -> DataFrame:
    """Active members of renamed groups re-appended with the new name."""
    return current_members.drop(name_col).join(renamed.select(group_col, name_col), group_col, "inner")


def groups_with_counts(groups: DataFrame, members: DataFrame, group_col: str = "group_id") -> DataFrame:
    """Current groups with member counts, zero-filled."""
    c = members.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_members"))
    return groups.join(c, group_col, "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)))


# What the orphan detector writes.
DISCONTINUED, PURGED = "descontinuado", "purged"
DETECTOR = "system:orphan-detector"
PURGE_NOTE = "Descontinuada: será removida do Gold por um operador (com backup), nunca automaticamente."
PURGE_TARGETS = {
    "pevs": ("gold_pevs_production", "product_code"),
    "pam": ("gold_pam_production", "product_code"),
    "ppm": ("gold_ppm_production", "product_code"),
    "comex": ("gold_comex_flows", "ncm_code"),
    "comtrade": ("gold_comtrade_flows", "cmd_code"),
}


def auto_mark_orphans(orphans: DataFrame, lifecycle: DataFrame, keys: Sequence[str], now: dt.datetime,
                      removed_col: str = "removed_at", group_col: str | None = None) -> DataFrame:
    """A 'descontinuado' event for each orphan whose latest lifecycle event
    does not cover this removal.

    An event at or after the removal covers it, whatever its status; a newer
    removal is marked again.  Without a time to compare, a key already
    discontinued or purged is left.  The event id names the removal, so a re-run
    gives the same ids.  ``keys`` are the source, then the code."""
    status = latest_wins(lifecycle, list(keys), ["edited_at", "change_id"]).select(
        *keys, F.col("status").alias("_st"), F.col("edited_at").alias("_at"))
    removed = F.col(removed_col)
    covered = F.when(removed.isNotNull() & F.col("_at").isNotNull(), F.col("_at") >= removed).otherwise(
        F.col("_st").isin(DISCONTINUED, PURGED))
    todo = orphans.join(status, list(keys), "left").filter(~F.coalesce(covered, F.lit(False)))
    group = F.coalesce(F.col(group_col) if group_col else F.lit(None).cast("string"), F.lit("—"))
    gen = F.coalesce(F.date_format(removed, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("0"))
    return todo.select(
        *keys, F.lit(DISCONTINUED).alias("status"),
        F.concat(F.lit("Removida do cadastro; dados em Gold pendentes (agrupamento "), group, F.lit(").")).alias("reason"),
        F.lit(PURGE_NOTE).alias("purge_note"), F.lit(DETECTOR).alias("edited_by"), F.lit(now).cast("timestamp_ntz").alias("edited_at"),
        F.concat_ws(":", F.lit(DISCONTINUED), F.lit("commodity"), *[F.col(k).cast("string") for k in keys], gen).alias("change_id"))


def purge_plan(requests: DataFrame, lifecycle: DataFrame, active: DataFrame, source_col: str, code_col: str,
               backup: tuple[bool, str], dataset: str = "gold") -> DataFrame:
    """For each requested (source, code): why a purge is refused, or the
    statements an operator would run, and whether there is a snapshot to go back to.

    Refused are codes that are not digits alone ('invalid'), whose latest
    lifecycle event is not 'descontinuado' ('not_marked'), or that the catalogue
    holds again ('re_added').  Nothing is deleted.  ``backup`` is what
    ``snapshot.backup_status`` says; a plan is allowed with both."""
    keys = [source_col, code_col]
    r = requests.select(F.trim(source_col).alias(source_col), F.trim(code_col).alias(code_col)).distinct()
    now = latest_wins(lifecycle, keys, ["edited_at", "change_id"]).select(*keys, F.col("status").alias("_st"))
    back = active.select(*keys).distinct().withColumn("_back", F.lit(True))
    j = r.join(now, keys, "left").join(back, keys, "left")
    invalid = ~(F.coalesce(F.col(source_col) != "", F.lit(False)) & F.coalesce(F.col(code_col).rlike(r"\A[0-9]+\z"), F.lit(False)))
    refused = (F.when(invalid, "invalid").when(~F.col("_st").eqNullSafe(F.lit(DISCONTINUED)), "not_marked")
               .when(F.col("_back"), "re_added"))
    targets = F.create_map(*[x for s, (t, c) in PURGE_TARGETS.items() for x in (F.lit(s), F.concat(
        F.lit(f"DELETE FROM `{dataset}.{t}` WHERE {c} = '"), F.col(code_col), F.lit("';")))])
    j = j.withColumn("refused", refused)
    return j.select(*keys, "refused", F.when(F.col("refused").isNull(), targets[F.col(source_col)]).alias("statement"),
                    F.lit(bool(backup[0])).alias("backup_ok"), F.lit(backup[1]).alias("backup_msg"),
                    (F.col("refused").isNull() & F.lit(bool(backup[0]))).alias("allowed"))


def purge_event(plan: DataFrame, keys: Sequence[str], now: dt.datetime) -> DataFrame:
    """Terminal 'purged' event, id scoped to the generation."""
    return plan.filter("allowed").select(*keys, F.lit(PURGED).alias("status"),
                                         F.lit(now).cast("timestamp_ntz").alias("edited_at"),
                                         F.concat_ws(":", F.lit("purge"), *[F.col(k).cast("string") for k in keys]).alias("change_id"))


def catalog_worklist(catalog: DataFrame, group_col: str, source_col: str) -> DataFrame:
    """Per product group, its codes and the distinct sources."""
    return catalog.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_codes"),
        F.array_sort(F.collect_set(source_col)).alias("sources"))


def code_status(catalog: DataFrame, data: DataFrame, code: str, year: str) -> DataFrame:
    """Per catalogued code: rows, first/last year, has data."""
    stats = data.groupBy(code).agg(F.count(F.lit(1)).alias("n_rows"), F.min(year).alias("first_year"),
                                   F.max(year).alias("last_year"))
    return catalog.join(stats, code, "left").withColumn("has_data", F.col("n_rows").isNotNull()).withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0)))


def level_worklist(catalog: DataFrame, levels: DataFrame, code: str, level: str) -> tuple[DataFrame, DataFrame]:
    """Catalogue codes with their current level (NULL = to do) and
    the count of codes per level."""
    w = catalog.join(levels.select(code, level), code, "left")
    counts = w.groupBy(level).agg(F.count(F.lit(1)).alias("n_codes"))
    return w, counts


def matrix_with_mapping(cells: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every (regime, flow) cell with values, and every mapping,
    full outer joined."""
    return cells.join(mapping, list(keys), "full_outer")


def seed_missing(config: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configured rows not yet in the log (first load only)."""
    return config.join(current.select(*keys), list(keys), "left_anti")
