"""Notes: rendering, supersession, candidates for reconciliation, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.text import tokens
from recallspark.functions.vectors import cosine, usable
from recallspark.operators.lexical import every_salt, salted

#: Attributes whose newer value replaces the older one.
STATEFUL = (
    "job occupation work career employer role location home residence city address relationship status marital_status partner "
    "health condition plan goal current_project preference favourite favorite contact phone email pet vehicle car school study course"
).split()


def note_key() -> Column:
    return F.concat(F.lower(F.trim("subject")), F.lit("::"), F.lower(F.trim("attribute")))


def is_active() -> Column:
    """NULL counts as active, however the word is written."""
    return F.coalesce(F.lower(F.trim("status")), F.lit("active")) == "active"


def render() -> Column:
    """Statement, its date if the text lacks it, and when it was superseded."""
    statement = F.trim(F.coalesce("statement", F.lit("")))
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    when = F.coalesce(blank("event_time"), blank("recorded_time"))
    dated = F.when(when.isNotNull() & ~F.contains(statement, when), F.concat(F.lit("(as of "), when, F.lit(")")))
    over = F.when(~is_active() & blank("valid_until").isNotNull(), F.concat(F.lit("[superseded on "), F.col("valid_until"), F.lit("]")))
    return F.concat_ws(" ", statement, dated, over)


def supersede(standing: DataFrame) -> DataFrame:
    """Each standing note's successor in its key; an end that is set stays set."""
    w = Window.partitionBy("conv_id", "note_key").orderBy("day")
    after, day = F.lead("note_id").over(w), F.lead("day").over(w)
    return standing.select(
        "conv_id", "note_key", "note_id", "day", F.when(after.isNotNull(), "superseded").otherwise("active").alias("status"),
        after.alias("superseded_by"), F.coalesce("until", day).alias("valid_until"),
    )


def plain_statement() -> Column:
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(F.coalesce("statement", F.lit("")), r"\s+", " "))), r"[\s.]+$", "")


def review_classes(notes: DataFrame) -> DataFrame:
    """note_id, note_key, class_id, links for each active note of a key with more than one statement.

    Notes of one statement are a class, named by its first note. A note is linked with
    every active note of its key that says something else; ``links`` counts them, so
    class and count hold all pairs without any being written.
    ``notes``: conv_id, note_id, subject, attribute, statement, status.
    """
    rows = notes.where(is_active()).select("conv_id", note_key().alias("note_key"), plain_statement().alias("value"), "note_id")
    values = rows.groupBy("conv_id", "note_key", "value").agg(F.min("note_id").alias("class_id"), F.count("*").alias("copies"))
    keys = values.groupBy("conv_id", "note_key").agg(F.sum("copies").alias("notes"), F.count("*").alias("values")).where(F.col("values") > 1)
    found = rows.join(values, ["conv_id", "note_key", "value"]).join(keys, ["conv_id", "note_key"])
    return found.select("conv_id", "note_key", "note_id", "class_id", (F.col("notes") - F.col("copies")).alias("links"))


def flag_for_review(packs: DataFrame, notes: DataFrame) -> DataFrame:
    """Pairs id_a < id_b of active notes of one key and different statements that share a pack.

    ``packs``: qid, note_id. A pack is bounded by its configuration, so pairs are made inside it.
    """
    rows = notes.where(is_active()).select("note_id", note_key().alias("note_key"), F.lower(F.trim("statement")).alias("value"))
    held = packs.select("qid", "note_id").distinct().join(rows, "note_id")
    other = held.select("qid", "note_key", F.col("note_id").alias("id_b"), F.col("value").alias("other"))
    pairs = held.join(other, ["qid", "note_key"]).where((F.col("note_id") < F.col("id_b")) & (F.col("value") != F.col("other")))
    return pairs.select(F.col("note_id").alias("id_a"), "id_b", "note_key").distinct()


def words_of(text: Column) -> Column:
    """Lower-case words, and compounds with hyphen or apostrophe beside their parts."""
    low = F.lower(text)
    return F.array_distinct(F.concat(tokens(text), F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)+)"), F.lit(1))))


def note_entities(notes: DataFrame, names: DataFrame) -> DataFrame:
    """conv_id, note_id, entity: names (of three letters or more) in a note's subject or statement, whatever their case.

    Names are single words, so they meet the note's words in an equi-join. ``names``: conv_id, name.
    """
    words = notes.select("conv_id", "note_id", F.explode(words_of(F.concat_ws(" ", "subject", "statement"))).alias("word"))
    wanted = names.where(F.length("name") >= 3).select("conv_id", F.col("name").alias("entity"), F.lower("name").alias("word")).distinct()
    return words.join(wanted, ["conv_id", "word"]).select("conv_id", "note_id", "entity").distinct()


def scope_sizes(entities: DataFrame) -> DataFrame:
    """How many notes each entity scopes."""
    return entities.groupBy("conv_id", "entity").agg(F.count("*").alias("notes"))


def reconcile_candidates(
    fresh: DataFrame, known: DataFrame, entities: DataFrame | None = None, dim: int = 96, same_key: float = 0.6, alike: float = 0.8, most: int = 4, earlier: bool = True
) -> DataFrame:
    """For each fresh note the ``most`` newest known ones it may update, repeat or contradict.

    Three ways in: the same key and a similarity of ``same_key``; the same subject and
    ``alike``; a shared entity (``entities``: conv_id, note_id, entity) and ``alike``.
    A key implies its subject, so the first two are one join. Known notes of a
    frequent subject or entity are spread over ``SALTS`` tasks. Newest by valid_from,
    else recorded_time, as written; ties by id. ``earlier``: only notes with a smaller id.
    """
    when = F.coalesce(F.when(F.trim("valid_from") != "", F.col("valid_from")), F.col("recorded_time"), F.lit(""))
    cols = ["conv_id", "note_id", F.lower(F.trim("subject")).alias("subject"), note_key().alias("key")]
    a = fresh.where(usable(F.col("embedding"), dim)).select(*cols, "attribute", "embedding")
    b = known.where(usable(F.col("embedding"), dim)).select(*cols, "embedding", when.alias("when"))
    keys = [a.select("conv_id", "note_id", F.concat(F.lit("s:"), "subject").alias("at"))], [b.select("conv_id", "note_id", F.concat(F.lit("s:"), "subject").alias("at"))]
    if entities is not None:
        scope = entities.select("conv_id", "note_id", F.concat(F.lit("e:"), "entity").alias("at"))
        keys[0].append(scope.join(a.select("note_id"), "note_id", "left_semi"))
        keys[1].append(scope.join(b.select("note_id"), "note_id", "left_semi"))
    one, two = (reduce(DataFrame.unionByName, k) for k in keys)
    two = salted(two.withColumnRenamed("note_id", "other_id"), "other_id")
    pairs = every_salt(one).join(two, ["conv_id", "at", "_salt"])
    pairs = pairs.where((F.col("other_id") < F.col("note_id")) if earlier else (F.col("other_id") != F.col("note_id")))
    pairs = pairs.select("conv_id", "note_id", "other_id").distinct()
    other = b.select("conv_id", F.col("note_id").alias("other_id"), F.col("key").alias("other_key"), F.col("embedding").alias("other"), "when")
    rows = pairs.join(a, ["conv_id", "note_id"]).join(other, ["conv_id", "other_id"])
    rows = rows.withColumn("sim", F.round(cosine(F.col("embedding"), F.col("other")), 9))
    near = rows.where(((F.col("key") == F.col("other_key")) & (F.col("sim") >= same_key)) | (F.col("sim") >= alike))
    w = Window.partitionBy("note_id").orderBy(F.desc("when"), F.desc("other_id"))
    top = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    update = F.lower(F.trim("attribute")).isin(STATEFUL) & (F.col("key") == F.col("other_key")) & (F.col("sim") >= same_key)
    return top.select("conv_id", "note_id", "other_id", "sim", F.when(update, "update").otherwise("independent").alias("relation"))


def known_facts(notes: DataFrame, subjects: DataFrame, most: int = 25) -> DataFrame:
    """conv_id, session, facts: the ``most`` latest active notes about a session's subjects, one line each.

    ``subjects``: conv_id, session, subject; ``notes`` with ``order``, the order in which they were made.
    """
    rows = notes.where(is_active()).select("conv_id", F.lower("subject").alias("s"), "subject", "attribute", "statement", "order")
    asked = subjects.select("conv_id", "session", F.lower("subject").alias("s")).distinct()
    w = Window.partitionBy("conv_id", "session").orderBy(F.desc("order"))
    top = asked.join(rows, ["conv_id", "s"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    line = F.concat(F.lit("- ["), "subject", F.lit("/"), "attribute", F.lit("] "), "statement")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("order", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("conv_id", "session").agg(F.array_join(lines, "\n").alias("facts"))


def apply_relations(notes: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes with those superseded marked, the conflicts, and how often each operation was applied.

    ``judged``: old_id, new_id, relation, reason. Of several updates of one note the
    first (by new id) stands, and a note superseded before stays as it is.
    """
    new = notes.select(F.col("note_id").alias("new_id"), F.coalesce("valid_from", "recorded_time").alias("when"))
    updates = judged.where(F.col("relation") == "update").join(new, "new_id").groupBy(F.col("old_id").alias("note_id")).agg(F.min(F.struct("new_id", "when")).alias("u"))
    marked = notes.join(updates, "note_id", "left")
    hit = F.col("u").isNotNull() & is_active()
    changed = {"status": F.when(hit, "superseded").otherwise(F.col("status")), "superseded_by": F.when(hit, F.col("u.new_id")).otherwise(F.col("superseded_by")), "valid_until": F.when(hit, F.col("u.when")).otherwise(F.col("valid_until"))}
    said = lambda side: notes.select(F.col("note_id").alias(f"note_{side}"), F.col("statement").alias(f"statement_{side}"), F.coalesce("event_time", "recorded_time").alias(f"time_{side}"))
    against = judged.where(F.col("relation") == "conflict").select(F.col("old_id").alias("note_a"), F.col("new_id").alias("note_b"), "reason")
    names = {"same": "noop", "update": "update", "conflict": "conflict"}
    op = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("relation")), F.lit("add"))
    return marked.withColumns(changed).drop("u").select(*notes.columns), against.join(said("a"), "note_a").join(said("b"), "note_b"), judged.groupBy(op.alias("op")).count()


def note_totals(notes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row: notes, active and superseded ones, distinct subjects, conflicts."""
    n = notes.agg(
        F.count("*").alias("notes"), F.sum(is_active().cast("bigint")).alias("active"), F.sum((~is_active()).cast("bigint")).alias("superseded"),
        F.countDistinct(F.lower(F.trim("subject"))).alias("subjects"),
    )
    return n.join(F.broadcast(conflicts.agg(F.count("*").alias("conflicts"))))  # one row


def conflicts_of(conflicts: DataFrame, packs: DataFrame) -> DataFrame:
    """qid and conflict for every conflict of which either note is in the pack. ``packs``: qid, note_id."""
    either = [packs.select("qid", F.col("note_id").alias(side)).join(conflicts, side).select("qid", *conflicts.columns) for side in ("note_a", "note_b")]
    return either[0].unionByName(either[1]).distinct()
