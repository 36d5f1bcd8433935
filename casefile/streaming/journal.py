"""The decision journal: revisions, review changes and payload checks, as batch jobs and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from casefile.functions.ordered import chunk_of, neighbours, number_rows, running_max

CLEAN = "clean"


def journal_states(events: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each journal event is accepted, and the revision after it.

    ``events``: keys, arrival (order), revision, action (``clean`` or a write). A write needs
    a higher revision than the current one; a clean mark at least the current one of an
    existing journal, and it moves the journal one revision on. A refused event never
    exceeds the current revision, so the current revision is a running maximum.
    """
    clean = F.col("action") == CLEAN
    valid = F.coalesce(F.col("revision") >= 1, F.lit(False))
    first = events.filter(~clean & valid).groupBy(*keys).agg(F.min("arrival").alias("_first"))
    rows = events.join(first, keys, "left").withColumn("_chunk", F.floor(F.col("arrival") / 65536))
    opened = F.coalesce(F.col("arrival") > F.col("_first"), F.lit(False))
    reached = F.when(~clean & valid, F.col("revision")).when(clean & valid & opened, F.col("revision") + 1)
    rows = running_max(rows.withColumn("_reached", reached), keys, ["arrival"], "_reached", "_before", ["_chunk"])
    accepted = valid & F.when(clean, opened & (F.col("revision") >= F.col("_before"))).otherwise(
        F.col("_before").isNull() | (F.col("revision") > F.col("_before"))
    )
    rows = rows.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    return rows.withColumn("current_revision", F.greatest("_before", F.when(F.col("accepted"), F.col("_reached")))).select(
        *keys, "arrival", "action", "revision", "accepted", "current_revision"
    )


def journal_latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current revision of each journal, and whether it holds unsaved work."""
    states = journal_states(events, keys).filter("accepted")
    last = F.max_by(F.struct("current_revision", "action"), "arrival").alias("last")
    rows = states.groupBy(*keys).agg(last, F.max("arrival").alias("last_arrival"))
    return rows.select(*keys, F.col("last.current_revision").alias("revision"), (F.col("last.action") != CLEAN).alias("dirty"), "last_arrival")


class RevisionKeeper(StatefulProcessor):
    """Current revision and dirty flag of one journal; refused events are returned, marked as such."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("revision", LongType()), StructField("dirty", BooleanType())])
        self.current = handle.getValueState("current", schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        revision = self.current.get()[0] if self.current.exists() else None
        dirty = self.current.get()[1] if self.current.exists() else False
        batch = pd.concat(list(rows)).sort_values("arrival")
        out = []
        for arrival, action, wanted in zip(batch["arrival"], batch["action"], batch["revision"]):
            if action == CLEAN:
                accepted = wanted >= 1 and revision is not None and wanted >= revision
                reached = wanted + 1
            else:
                accepted = wanted >= 1 and (revision is None or wanted > revision)
                reached = wanted
            if accepted:
                revision, dirty = int(reached), action != CLEAN
            out.append((key[0], arrival, action, wanted, bool(accepted), revision))
        if revision is not None:
            self.current.update((int(revision), bool(dirty)))
        yield pd.DataFrame(out, columns=["journal_id", "arrival", "action", "revision", "accepted", "current_revision"]).astype(
            {"current_revision": "Int64"}
        )

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def journal_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of ``journal_states`` (key ``journal_id``); needs the RocksDB state store.

    Events of one micro-batch are applied in arrival order. Across micro-batches a late event
    is handled as the journal handles it: its revision is not above the current one.
    """
    schema = "journal_id long, arrival long, action string, revision long, accepted boolean, current_revision long"
    return events.groupBy("journal_id").transformWithStateInPandas(
        statefulProcessor=RevisionKeeper(), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def review_changes(baseline: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """State of every candidate after a series of review edits.

    ``baseline``: keys, candidate_id, evidence_id, source_sha256, repeat_decision, confirmed.
    ``events``: keys, candidate_id, at (unique order > 0), action, and new_evidence and
    new_sha256 for ``source``, new_decision for ``repeat``. Other actions: ``confirm``,
    ``pages`` (revokes the row), ``label`` (description or date: changes nothing here).

    A change of source revokes the confirmation of every candidate that holds the old or the
    new content at that moment. Instead of replaying a matter in one task, the holding times
    of each candidate are laid beside the revocations of each content; the last of them
    inside a holding time is a running maximum per content.
    """
    on = [*keys, "candidate_id"]
    known = events.join(baseline.select(*on), on, "left_semi")

    def in_order(action: str, value: list[str], initial: list[str]) -> DataFrame:
        start = baseline.select(*on, F.lit(0).cast("long").alias("at"), *[F.col(i).alias(v) for i, v in zip(initial, value)])
        rows = start.unionByName(known.filter(F.col("action") == action).select(*on, "at", *value))
        rows = number_rows(rows.withColumn("_chunk", F.floor(F.col("at") / 65536)), on, ["at"], "_n", ["_chunk"]).drop("_chunk")
        return neighbours(rows, on, "_n", ["at", *value])

    held = in_order("source", ["new_evidence", "new_sha256"], ["evidence_id", "source_sha256"])
    changed = ~F.col("new_evidence").eqNullSafe(F.col("prev_new_evidence")) & (F.col("at") > 0)
    content = [*keys, "sha256"]
    revoked = held.filter(changed).select(*keys, "at", F.explode(F.array("new_sha256", "prev_new_sha256")).alias("sha256"))
    revoked = revoked.filter("sha256 IS NOT NULL").distinct()
    last = 2**61
    # one row per holding time, placed at its end; revocations at the same moment sort before it
    ends = held.filter("new_sha256 IS NOT NULL").select(
        *on, F.col("new_sha256").alias("sha256"), F.col("at").alias("since"), (F.coalesce("next_at", F.lit(last)) * 2 - 1).alias("moment")
    )
    nothing = F.lit(None)
    marks = revoked.select(*keys, nothing.cast("string").alias("candidate_id"), "sha256", nothing.cast("long").alias("since"), (F.col("at") * 2).alias("moment"))
    line = ends.unionByName(marks).withColumn("_mark", F.when(F.col("since").isNull(), F.col("moment") / 2).cast("long"))
    line = line.withColumn("_chunk", F.floor(F.col("moment") / 131072))
    line = running_max(line, content, ["moment", "candidate_id"], "_mark", "_last", ["_chunk"])
    by_sibling = line.filter("since IS NOT NULL AND _last >= since").groupBy(*on).agg(F.max("_last").alias("sibling_at"))
    repeats = in_order("repeat", ["new_decision"], ["repeat_decision"])
    repeat_at = repeats.filter((F.col("at") > 0) & ~F.col("new_decision").eqNullSafe(F.col("prev_new_decision")))
    repeat_at = repeat_at.groupBy(*on).agg(F.max("at").alias("repeat_at"))
    own = known.groupBy(*on).agg(
        F.max(F.when(F.col("action") == "confirm", F.col("at"))).alias("confirm_at"),
        F.max(F.when(F.col("action").isin("pages", "source"), F.col("at"))).alias("edit_at"),
        F.max_by(F.when(F.col("action") == "source", F.struct("new_evidence", "new_sha256")), F.when(F.col("action") == "source", F.col("at"))).alias("src"),
        F.max_by(F.when(F.col("action") == "repeat", F.struct("new_decision")), F.when(F.col("action") == "repeat", F.col("at"))).alias("rep"),
    )
    rows = baseline.join(own, on, "left").join(by_sibling, on, "left").join(repeat_at, on, "left")
    undone = F.greatest("edit_at", "sibling_at", "repeat_at")
    confirmed = (
        F.when(F.col("confirm_at").isNotNull() & (undone.isNull() | (F.col("confirm_at") > undone)), True)
        .when(undone.isNotNull(), False).otherwise(F.col("confirmed"))
    )
    return rows.select(
        *on,
        F.when(F.col("src").isNotNull(), F.col("src.new_evidence")).otherwise(F.col("evidence_id")).alias("evidence_id"),
        F.when(F.col("src").isNotNull(), F.col("src.new_sha256")).otherwise(F.col("source_sha256")).alias("source_sha256"),
        F.when(F.col("rep").isNotNull(), F.col("rep.new_decision")).otherwise(F.col("repeat_decision")).alias("repeat_decision"),
        confirmed.alias("confirmed"),
    )


REVIEWED = "evidence_id string, source_sha256 string, repeat_decision string, confirmed boolean, confirmed_at long, step long"


class CandidateKeeper(StatefulProcessor):
    """What one candidate holds and its own confirmation; each edit gives a row of the log."""

    def __init__(self, keys: list[str]) -> None:
        self.columns = [*keys, "candidate_id", "at", *[c.split()[0] for c in REVIEWED.split(", ")], "revoked"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", REVIEWED)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        first = initialState.iloc[0]
        confirmed = None if pd.isna(first["confirmed"]) else bool(first["confirmed"])
        self.held.update((*[_text(first[c]) for c in ("evidence_id", "source_sha256", "repeat_decision")], confirmed, 0, 0))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return  # edits of unknown candidates change nothing
        evidence, sha256, decision, confirmed, confirmed_at, step = self.held.get()
        out = []
        for row in pd.concat(list(rows)).sort_values("at").itertuples(index=False):
            at, revoked = int(row.at), []
            if row.action == "confirm":
                confirmed, confirmed_at = True, at
            elif row.action == "pages":
                confirmed = False
            elif row.action == "source":
                chosen, content = _text(row.new_evidence), _text(row.new_sha256)
                if chosen != evidence:
                    revoked = sorted({sha256, content} - {None})
                evidence, sha256, confirmed = chosen, content, False
            elif row.action == "repeat":
                confirmed = confirmed if _text(row.new_decision) == decision else False
                decision = _text(row.new_decision)
            step += 1
            out.append((*key, at, evidence, sha256, decision, confirmed, confirmed_at, step, revoked))
        self.held.update((evidence, sha256, decision, confirmed, confirmed_at, step))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _text(value: Any) -> str | None:
    return None if value is None or value != value else str(value)


def review_change_stream(events: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Streaming twin of ``review_changes``: a log with one row per edit of a known candidate, to be appended to a table.

    A row has what the candidate holds after the edit, its own confirmation and when it was given, and the contents whose
    holders the edit revokes. ``review_state`` reads the log. Revocation crosses candidates, yet no edit touches the state
    of another one: holders are not visited, and the state written grows with the edited candidates, not with the matter.
    So the key is the candidate, and a matter of any size spreads. Needs the RocksDB state store.

    Edits of a candidate within a micro-batch are applied by ``at``; across micro-batches as they arrive. ``at`` alone
    decides between a confirmation of one candidate and a revocation by another.
    """
    on = [*keys, "candidate_id"]
    types = dict(events.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in on), "at long", REVIEWED, "revoked array<string>"])
    start = baseline.select(*on, "evidence_id", "source_sha256", "repeat_decision", "confirmed")
    return events.groupBy(*on).transformWithStateInPandas(
        statefulProcessor=CandidateKeeper(keys), outputStructType=schema, outputMode="Append", timeMode="None", initialState=start.groupBy(*on)
    )


def review_state(baseline: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """State of every candidate, in the columns of ``review_changes``, after the edits of a ``review_change_stream`` log.

    A confirmation holds if no revocation of the content held came after it. Revocations of a content are a partial
    aggregate, so a content that very many candidates hold is no hot key.
    """
    on = [*keys, "candidate_id"]
    held = ["evidence_id", "source_sha256", "repeat_decision", "confirmed"]
    last = log.groupBy(*on).agg(F.max_by(F.struct(*held, "confirmed_at"), "step").alias("_last"))
    revoked = log.select(*keys, "at", F.explode("revoked").alias("source_sha256")).groupBy(*keys, "source_sha256").agg(F.max("at").alias("_revoked_at"))
    rows = baseline.join(last, on, "left")
    now = [F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in held]
    rows = rows.select(*on, *now, F.coalesce("_last.confirmed_at", F.lit(0)).alias("_confirmed_at")).join(revoked, [*keys, "source_sha256"], "left")
    confirmed = F.when(F.col("_revoked_at") > F.col("_confirmed_at"), False).otherwise(F.col("confirmed"))
    return rows.select(*on, "evidence_id", "source_sha256", "repeat_decision", confirmed.alias("confirmed"))


# Fields and limits of a journal payload.
PAYLOAD_FIELDS = [
    "project", "candidates", "arrangement", "finalOrder", "layout", "pagination", "resolutions", "statements", "templates",
    "templateReviews", "templateDiscrepancyConfirmation", "sources", "fingerprint", "pageSizeChoices",
]
MAX_PAYLOAD_BYTES, MAX_SOURCES, MAX_ROWS, MAX_ORDER_ID = 8 * 1024 * 1024, 5_000, 20_000, 1_024
PAYLOAD_SCHEMA = (
    "sources array<struct<id:string>>, candidates array<string>, resolutions array<string>, finalOrder array<string>, "
    "arrangement string, pageSizeChoices map<string,string>, templateReviews array<string>"
)


def validate_journal(journal: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Broken rules of each payload, one row per rule."""
    text = F.col(payload)
    p = F.from_json(text, PAYLOAD_SCHEMA)
    rows = journal.withColumn("_p", p).withColumn("_keys", F.json_object_keys(text))
    sources, order = F.col("_p.sources"), F.col("_p.finalOrder")
    ids = F.transform(sources, lambda s: s["id"])

    def too_many(name: str) -> Column:
        return F.coalesce(F.size(F.col(f"_p.{name}")) > MAX_ROWS, F.lit(False))

    bad_order = F.exists(order, lambda i: (F.length(i) == 0) | (F.length(i) > MAX_ORDER_ID) | i.contains("\0"))
    choices = F.exists(F.map_values("_p.pageSizeChoices"), lambda v: ~v.isin("convert-to-a4", "keep-original"))
    rules = [
        (F.col("_keys").isNull(), "payload is not an object"),
        (F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in PAYLOAD_FIELDS]))) > 0, "unsupported field"),
        (F.octet_length(text) > MAX_PAYLOAD_BYTES, "payload is too large"),
        (F.coalesce(F.size(sources), F.lit(0)).between(1, MAX_SOURCES) == F.lit(False), "invalid number of sources"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate source ids"),
        (F.col("_p.arrangement").isNotNull() & order.isNotNull(), "arrangement and legacy order"),
        (too_many("candidates") | too_many("finalOrder") | too_many("resolutions"), "too many review records"),
        (bad_order | (F.size(F.array_distinct(order)) < F.size(order)), "invalid or duplicate order ids"),
        (choices, "invalid page-size choice"),
        (F.size("_p.templateReviews") > 4, "invalid template reviews"),
    ]
    found = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules])
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))
