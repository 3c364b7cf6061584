"""The catalogue's derived tables emptied, in one commit, in the order of their references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from linkcatalog.store import Change, Put, Store, Upsert, Version

#: Tables and those that they refer to. ``source`` is set up by hand and stays.
REFERS = {
    "source": (), "document": ("source",), "work": (), "media": ("work",), "resource": (), "bridge": ("media", "resource"), "tag": (), "media_tag": ("media", "tag"),
    "extraction": ("document",), "link_check": (), "media_count": ("media",), "work_count": ("work",), "repair_task": ("media",), "fetch_report": ("source",),
}
KEPT = ("source", "source_queue")
#: What a source knows of where it is.
WATERMARKS = {"cursor": None, "cursor_at": None, "pending": None, "backfill": None, "backfill_done": False, "state": None}
#: What a document knows of how far its parsing is.
PARSING = {"parse_status": "pending", "attempts": 0, "parse_error": None, "lease_until": None, "lease_token": None, "next_parse_at": None, "last_parsed_at": None}


@dataclass
class ResetReport:
    """``tables``: those emptied, in order; ``before``, ``after``: rows of all tables; ``snapshot``: the version
    before, to which :meth:`Store.restore` goes back."""

    tables: list[str] = field(default_factory=list)
    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)
    cursors_reset: bool = False
    checks_purged: bool = False
    documents_requeued: int = 0
    snapshot: int = 0


def leaves_first(refers: dict[str, tuple[str, ...]]) -> list[str]:
    """Each table before those that it refers to."""
    left, out = dict(refers), []
    while left:
        free = [t for t in left if not any(t in r for o, r in left.items() if o != t)]
        if not free:
            raise ValueError("tables refer to each other in a ring")
        out += free
        left = {t: r for t, r in left.items() if t not in free}
    return out


def data_tables(tables: dict, keep_documents: bool = False, purge_checks: bool = False) -> list[str]:
    """The tables of a version that a reset empties: all but sources, the checks' history (which no link owns, and
    which is dear) unless ``purge_checks``, and documents if they are kept."""
    skip = {*KEPT, *(() if purge_checks else ("link_check",)), *(("document", "document_queue") if keep_documents else ())}
    known = {t: tuple(r for r in REFERS.get(t, ()) if r in tables) for t in tables}
    return [t for t in leaves_first(known) if t not in skip]


def reset(store: Store, keep_documents: bool = False, keep_cursors: bool = False, purge_checks: bool = False) -> ResetReport:
    """Empties what was derived and sets sources back to their start; with ``keep_documents`` documents are queued
    anew instead, and cursors stay. All in one commit: a failure before it leaves every table as it was."""
    keep_cursors = keep_cursors or keep_documents
    report = ResetReport(cursors_reset=not keep_cursors, checks_purged=purge_checks)

    def work(at: Version) -> dict[str, Change]:
        report.tables = data_tables(at.tables, keep_documents, purge_checks)
        report.before = {t: store.read(t, at).count() for t in at.tables}
        report.snapshot, report.documents_requeued = at.number, 0
        changes: dict[str, Change] = {}
        for t in report.tables:
            rows = store.read(t, at)
            changes[t] = Put(store.spark.createDataFrame([], rows.schema), at.tables[t]["key"])
        blank = {} if keep_cursors else {"source": WATERMARKS}
        if keep_documents:
            blank |= {t: PARSING for t in ("document", "document_queue") if t in at.tables and "parse_status" in store.read(t, at).columns}
        for t, values in blank.items():
            if t in at.tables:
                rows = store.read(t, at)
                kinds = dict(rows.dtypes)
                changes[t] = Upsert(rows.select(*[F.lit(values[c]).cast(kinds[c]).alias(c) if c in values else F.col(c) for c in rows.columns]))
                if values is PARSING:
                    report.documents_requeued += report.before[t]
        return changes

    done = store.transact(work) or store.current()
    report.after = {t: store.read(t, done).count() for t in done.tables}
    return report
