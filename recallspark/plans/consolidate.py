"""Notes from sessions: extraction, reconciliation with what is known, contradictions.

Sessions of one conversation depend on each other (a session's prompt shows what is
known by then), those of different conversations do not. So a task takes whole
conversations, reads their sessions in order as they stream in and keeps of each
conversation only its active notes; how many jobs run does not depend on the number
of sessions. ``Ledger`` applies the rules of ``operators.notes`` (``known_facts``,
``reconcile_candidates``, ``apply_relations``) one session at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recallspark.functions.jsonx import balanced_object, first_json_object, items_in, items_of
from recallspark.models import Encoder, HashEncoder, call_column, called
from recallspark.operators import notes as O
from recallspark.plans.reader import fill
from recallspark.session import stash

EXTRACT = (
    "Read one session of a conversation and note what is worth remembering about the people in it: facts, plans, preferences, events, each in a sentence that stands alone. "
    "Session date: {date}\n{known}\nSESSION:\n{transcript}\n\nReply with JSON alone, at most eight notes: "
    '{"notes": [{"subject": "who or what", "attribute": "which aspect", "statement": "...", "event_time": "when, or null"}]}'
)
ADJUDICATE = (
    "Each pair holds an earlier and a later note. Say how the later relates to the earlier: same (says it again), update (replaces it), conflict (both cannot be true), "
    'independent.\n\n{pairs}\n\nReply with JSON alone: {"relations": [{"pair": 1, "relation": "...", "reason": "a few words"}]}'
)
ITEM = "subject string, attribute string, statement string, event_time string"
RELATION = "pair string, relation string, reason string"
NOTE = (
    "conv_id string, note_id string, subject string, attribute string, statement string, event_time string, recorded_time string, valid_from string, valid_until string, "
    "status string, superseded_by string, provenance array<string>, evidence_ids array<string>, session string, order bigint, embedding array<float>"
)

ENDED = "note_id string, superseded_by string, valid_until string"
CONFLICT = "note_b string, note_a string, reason string, statement_a string, time_a string, statement_b string, time_b string"
EVENT = ", ".join(f"{k} struct<{v.replace(' ', ':').replace(',:', ',')}>" for k, v in (("note", NOTE), ("ended", ENDED), ("conflict", CONFLICT))) + ", op string, count bigint"
RELATIONS = ("same", "update", "conflict", "independent")


@dataclass
class ConsolidationConfig:
    most_notes: int = 8
    most_pairs: int = 20  # pairs of one call; more pairs are more calls
    most_facts: int = 25
    extract_tokens: int = 768
    adjudicate_tokens: int = 512
    use_model: bool = True
    group_scoped: bool = True


def sessions_of(episodes: DataFrame) -> DataFrame:
    """conv_id, session, transcript, ids, evidence, subjects of each session, whose name is its stamp's text.

    ``episodes``: conv_id, episode_id, seq, text, session, stamp, speakers, evidence_ids. A session is a sitting, so it is one row.
    """
    rows = episodes.withColumn("session", F.coalesce("stamp", F.lit("unknown")))
    none = F.array().cast("array<string>")
    lines = F.array_sort(F.collect_list(F.struct("seq", "text", "episode_id", F.coalesce("evidence_ids", none).alias("e"), F.coalesce("speakers", none).alias("s"))))
    grouped = rows.groupBy("conv_id", "session").agg(lines.alias("u"))
    part = lambda c: F.transform("u", lambda x: x[c])
    return grouped.select(
        "conv_id", "session", F.array_join(part("text"), "\n").alias("transcript"), part("episode_id").alias("ids"),
        F.array_distinct(F.flatten(part("e"))).alias("evidence"), F.array_distinct(F.flatten(part("s"))).alias("subjects"),
    )


def filled(template: str, **parts: str | None) -> str:
    """``fill`` outside Spark."""
    return re.sub(r"\{(" + "|".join(parts) + r")\}", lambda m: parts[m[1]] or "", template)


def tidy(text: str | None) -> str:
    return (text or "").strip(" ")


class Ledger:
    """The active notes of one conversation, and what each further session changes.

    ``session`` returns rows of ``EVENT``: notes made, notes ended, conflicts and
    counted operations. Notes of one session are not held against each other.
    """

    def __init__(self, conv_id: str | None, names: set[str], model, cfg: ConsolidationConfig, encoder: Encoder) -> None:
        self.conv_id, self.names, self.model, self.cfg, self.encoder = conv_id, names, model, cfg, encoder
        self.rounds = 0
        self.active: dict[str, dict] = {}
        self.told: dict[str, list] = defaultdict(list)  # by subject: (order, id)
        self.near: dict[str, list] = defaultdict(list)  # by subject or entity: (when, id)

    def session(self, row: dict) -> list[dict]:
        fresh = self.extract(row)
        made = {n["note_id"]: n for n in fresh}
        judged = self.adjudicate(self.candidates(fresh), made)
        events = [{"note": {k: v for k, v in n.items() if not k.startswith("_")}} for n in fresh]
        ended: dict[str, str] = {}
        for old, new, relation, reason in judged:
            a, b = self.active[old], made[new]
            if relation == "update":
                ended[old] = min(ended.get(old, new), new)
            elif relation == "conflict":
                said = {f"{k}_{side}": v for side, n in (("a", a), ("b", b)) for k, v in (("note", n["note_id"]), ("statement", n["statement"]), ("time", dated(n)))}
                events.append({"conflict": said | {"reason": reason}})
        ops = Counter({"same": "noop", "update": "update", "conflict": "conflict"}.get(j[2], "add") for j in judged)
        events += [{"op": op, "count": n} for op, n in ops.items()]
        for old, new in ended.items():
            events.append({"ended": {"note_id": old, "superseded_by": new, "valid_until": made[new]["valid_from"]}})
            self.drop(self.active.pop(old))
        if self.conv_id is not None:
            for n in fresh:
                self.keep(n)
        self.rounds += 1
        return events

    def keep(self, n: dict) -> None:
        self.active[n["note_id"]] = {k: v for k, v in n.items() if k not in ("provenance", "evidence_ids")}
        insort(self.told[n["_subject"]], (n["order"], n["note_id"]))
        for at in n["_at"]:
            insort(self.near[at], (n["_when"], n["note_id"]))

    def drop(self, n: dict) -> None:
        for held, key in [(self.told[n["_subject"]], (n["order"], n["note_id"])), *((self.near[at], (n["_when"], n["note_id"])) for at in n["_at"])]:
            del held[bisect_left(held, key)]

    def facts(self, subjects: list[str | None]) -> str:
        """The latest active notes about a session's subjects, one line each."""
        most = self.cfg.most_facts
        of = {s.lower() for s in subjects if s is not None}
        latest = sorted(x for s in of if s in self.told for x in self.told[s][-most:])[-most:] if most > 0 else []
        return "\n".join("- [{subject}/{attribute}] {statement}".format_map(self.active[i]) for _, i in latest)

    def extract(self, row: dict) -> list[dict]:
        """Fresh notes of a session by one call; an unreadable reply gives none. Ids follow from conversation, session and position."""
        facts = self.facts(row["subjects"] or [])
        prompt = filled(EXTRACT, date=row["session"], known=f"\nALREADY KNOWN:\n{facts}\n" if facts else "", transcript=row["transcript"])
        text = called(self.model, prompt, [], max_tokens=self.cfg.extract_tokens, temperature=0.0).text
        items = items_in(balanced_object(text), "notes", ["subject", "attribute", "statement", "event_time"])[: self.cfg.most_notes]
        fresh = []
        for at, n in enumerate(n for n in items if tidy(n["subject"]) and tidy(n["statement"])):
            event = tidy(n["event_time"]) if tidy(n["event_time"]).lower() not in ("", "null") else None
            name = "|".join(x for x in (self.conv_id, row["session"], str(at)) if x is not None)
            fresh.append({
                "conv_id": self.conv_id, "note_id": sha256(name.encode()).hexdigest(), "subject": tidy(n["subject"]), "attribute": (tidy(n["attribute"]) or "fact").lower(),
                "statement": tidy(n["statement"]), "event_time": event, "recorded_time": row["session"], "valid_from": row["session"] if event is None else event, "valid_until": None,
                "status": "active", "superseded_by": None, "provenance": row["ids"], "evidence_ids": row["evidence"], "session": row["session"],
                "order": self.rounds * self.cfg.most_notes + at,
            })
        vectors = self.encoder.encode([f"{n['subject']} {n['attribute']}: {n['statement']}" for n in fresh]) if fresh else []
        for n, v in zip(fresh, vectors):
            v = np.asarray(v, np.float32)
            usable = np.isfinite(v).all() and v.any()
            n["embedding"] = v if usable else None
            n["_subject"], n["_when"] = n["subject"].lower(), n["valid_from"] if tidy(n["valid_from"]) else n["recorded_time"] or ""
            n["_key"] = f"{n['_subject']}::{n['attribute'].strip(' ')}"
            at = {"s:" + n["_subject"]} | {"e:" + e for e in self.entities(n)}
            n["_at"] = at if usable and len(v) == self.encoder.dim else set()
        return fresh

    def entities(self, n: dict) -> set[str]:
        low = f"{n['subject']} {n['statement']}".lower() if self.names else ""
        return self.names & {*re.findall(r"\w+", low), *re.findall(r"\w+(?:['’-]\w+)+", low)}

    def candidates(self, fresh: list[dict], same_key: float = 0.6, alike: float = 0.8, most: int = 4, block: int = 1024) -> list[tuple[str, str, str]]:
        """(old, new, relation without a model): for each fresh note the newest active ones near it."""
        pairs = []
        for n in fresh:
            lists = [self.near[at] for at in n["_at"] if at in self.near]
            known = lists[0] if len(lists) == 1 else sorted({x for one in lists for x in one})
            v = n["embedding"].astype(np.float64) if known else None
            found = 0
            for hi in range(len(known), 0, -block):
                some = [self.active[i] for _, i in reversed(known[max(0, hi - block) : hi])]
                x = np.stack([o["embedding"] for o in some]).astype(np.float64)
                length = np.sqrt((v * v).sum()) * np.sqrt((x * x).sum(1))
                sim = np.floor(np.divide(x @ v, length, out=np.zeros(len(x)), where=length > 0) * 1e9 + 0.5) / 1e9
                for j in np.flatnonzero(sim >= min(same_key, alike)):
                    same = some[j]["_key"] == n["_key"] and sim[j] >= same_key
                    if found < most and (same or sim[j] >= alike):
                        found += 1
                        update = same and n["attribute"].strip(" ") in O.STATEFUL
                        pairs.append((some[j]["note_id"], n["note_id"], "update" if update else "independent"))
                if found >= most:
                    break
        return pairs

    def adjudicate(self, pairs: list[tuple[str, str, str]], fresh: dict[str, dict]) -> list[tuple[str, str, str, str]]:
        """As ``adjudicate`` of frames, for the pairs of one session: (old, new, relation, reason)."""
        if not self.cfg.use_model or self.model is None:
            return [(*p, "no model") for p in pairs]
        pairs, judged = sorted(pairs, key=lambda p: (p[1], p[0])), []
        for lo in range(0, len(pairs), self.cfg.most_pairs):
            part = pairs[lo : lo + self.cfg.most_pairs]
            line = lambda i, a, b: f"{i}. EARLIER ({dated(a)}): {a['statement']}\n   LATER ({dated(b)}): {b['statement']}"
            prompt = filled(ADJUDICATE, pairs="\n".join(line(i, self.active[old], fresh[new]) for i, (old, new, _) in enumerate(part, 1)))
            text = called(self.model, prompt, [], max_tokens=self.cfg.adjudicate_tokens, temperature=0.0).text
            said: dict[int, list] = defaultdict(list)
            for r in items_in(balanced_object(text), "relations", ["pair", "relation", "reason"]):
                if re.fullmatch(r"\s*[+-]?[0-9]+\s*", r["pair"] or ""):
                    said[int(r["pair"])].append((r["relation"], r["reason"] or ""))
            for i, (old, new, fallback) in enumerate(part, 1):
                relation = max((r.strip(" ").lower() for r, _ in said[i] if r is not None), default=None)
                reason = "missing" if relation is None else max(w for _, w in said[i])
                judged.append((old, new, relation if relation in RELATIONS else fallback, reason))
        return judged


def dated(n: dict) -> str | None:
    return n["recorded_time"] if n["event_time"] is None else n["event_time"]


def adjudicate(pairs: DataFrame, notes: DataFrame, model, cfg: ConsolidationConfig) -> DataFrame:
    """old_id, new_id, relation, reason of candidate pairs (group, old_id, new_id, fallback).

    Pairs of a group (a session, a review) go to the model ``most_pairs`` at a time,
    numbered; an answer that is missing, or no known relation, falls back on the pair's own.
    """
    if not cfg.use_model or model is None:
        return pairs.select("old_id", "new_id", F.col("fallback").alias("relation"), F.lit("no model").alias("reason"))
    said = lambda side: notes.select(F.col("note_id").alias(f"{side}_id"), F.col("statement").alias(f"{side}_said"), F.coalesce("event_time", "recorded_time", F.lit("?")).alias(f"{side}_at"))
    w = Window.partitionBy("group").orderBy("new_id", "old_id")
    rows = pairs.join(said("old"), "old_id").join(said("new"), "new_id").withColumn("n", F.row_number().over(w) - 1)
    rows = rows.withColumn("call_no", F.floor(F.col("n") / cfg.most_pairs)).withColumn("pair", (F.col("n") % cfg.most_pairs + 1).cast("int"))
    line = F.concat(F.col("pair").cast("string"), F.lit(". EARLIER ("), "old_at", F.lit("): "), "old_said", F.lit("\n   LATER ("), "new_at", F.lit("): "), "new_said")
    rows = stash(rows.select("group", "call_no", "pair", "old_id", "new_id", "fallback", line.alias("line")), "pairs")
    calls = rows.groupBy("group", "call_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", "line"))), lambda x: x["line"]), "\n").alias("pairs"))
    done = call_column(calls.withColumn("prompt", fill(ADJUDICATE, pairs=F.col("pairs"))), "prompt", model, max_tokens=cfg.adjudicate_tokens, temperature=0.0)
    answers = done.select("group", "call_no", F.explode(items_of(first_json_object("call.text"), "relations", RELATION)).alias("r"))
    answers = answers.select("group", "call_no", F.col("r.pair").try_cast("int").alias("pair"), F.lower(F.trim("r.relation")).alias("said"), F.coalesce("r.reason", F.lit("")).alias("why"))
    answers = answers.where(F.col("pair").isNotNull()).groupBy("group", "call_no", "pair").agg(F.max("said").alias("said"), F.max("why").alias("why"))
    judged = rows.join(answers, ["group", "call_no", "pair"], "left")
    known = F.col("said").isin("same", "update", "conflict", "independent")
    reason = F.when(F.col("said").isNull(), F.lit("missing")).otherwise(F.col("why"))
    return judged.select("old_id", "new_id", F.when(known, F.col("said")).otherwise(F.col("fallback")).alias("relation"), reason.alias("reason"))


def consolidate(episodes: DataFrame, model, cfg: ConsolidationConfig = ConsolidationConfig(), encoder: Encoder | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All sessions into notes: (notes, conflicts, operations).

    ``names``: conv_id, name of the entities that scope candidates, if any.
    """
    encoder = encoder or HashEncoder()
    rows = sessions_of(episodes).withColumn("names", F.lit(None).cast("array<string>"))
    if cfg.group_scoped and names is not None:  # they come before the sessions of their conversation
        named = names.where(F.length("name") >= 3).groupBy("conv_id").agg(F.collect_set(F.lower("name")).alias("names"))
        rows = rows.unionByName(named, allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("session"))
    schema = to_arrow_schema(StructType.fromDDL(EVENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                events = []
                for row in batch.slice(at, 256).to_pylist():
                    if ledger is None or ledger.conv_id != row["conv_id"]:
                        ledger = Ledger(row["conv_id"], set(row["names"] or ()), model, cfg, encoder)
                    if row["session"] is not None:
                        events += ledger.session(row)
                yield pa.RecordBatch.from_pylist(events, schema)

    events = stash(rows.mapInArrow(run, EVENT), "events")
    held = lambda kind: events.where(F.col(kind).isNotNull()).select(f"{kind}.*")
    ended = held("ended").select("note_id", F.struct("superseded_by", "valid_until").alias("u"))
    store = held("note").join(ended, "note_id", "left")
    over = F.col("u").isNotNull()
    changed = {"status": F.when(over, "superseded").otherwise(F.col("status")), "superseded_by": F.col("u.superseded_by"), "valid_until": F.col("u.valid_until")}
    store = store.withColumns(changed).select(*[c.split()[0] for c in NOTE.split(", ")])
    return store, held("conflict"), events.where("op is not null").groupBy("op").agg(F.sum("count").alias("count"))


def reconcile_queue(queue: DataFrame, notes: DataFrame, model, cfg: ConsolidationConfig = ConsolidationConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queued pairs (id_a, id_b) of notes that are both still active, put in the order of time, judged and applied."""
    when = F.coalesce(F.when(F.col("valid_from") != "", F.col("valid_from")), F.col("recorded_time"), F.lit(""))
    active = notes.where(O.is_active()).select("note_id", "conv_id", when.alias("when"), F.lower(F.trim("attribute")).isin(O.STATEFUL).alias("stateful"))
    a = active.select(F.col("note_id").alias("id_a"), "conv_id", F.col("when").alias("at_a"), "stateful")
    b = active.select(F.col("note_id").alias("id_b"), F.col("when").alias("at_b"))
    rows = queue.select("id_a", "id_b").distinct().join(a, "id_a").join(b, "id_b")
    swap = F.col("at_a") > F.col("at_b")
    pairs = rows.select(
        F.col("conv_id").alias("group"), F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("old_id"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("new_id"),
        F.when(F.col("stateful"), "update").otherwise("independent").alias("fallback"),
    )
    return O.apply_relations(notes, adjudicate(stash(pairs, "queue"), notes, model, cfg))
