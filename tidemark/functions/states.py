"""State names of ledger rows and attempts, and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States as stored.
EMBRYO = "state_embryo"
IN_PROGRESS = "state_in_progress"
FINAL_RUN = "state_final_run"
PROCESSED = "state_processed"
SKIPPED = "state_skipped"
NOOP = "state_noop"
REQUESTED = "state_requested"
CANCELED = "state_canceled"
INVALID = "state_invalid"

# Kinds of attempts.
MANAGED = "type_managed"
FREERUN = "type_freerun"

JOB_ACTIVE = (EMBRYO, IN_PROGRESS, FINAL_RUN)
JOB_FINISHED = (PROCESSED, SKIPPED, NOOP)
ATTEMPT_ACTIVE = (REQUESTED, IN_PROGRESS, INVALID)
ATTEMPT_FINISHED = (PROCESSED, CANCELED, NOOP)


def _in(c: Column | str, states: tuple[str, ...]) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin(*states)


def is_active(c: Column | str, *, attempt: bool = False) -> Column:
    return _in(c, ATTEMPT_ACTIVE if attempt else JOB_ACTIVE)


def is_finished(c: Column | str, *, attempt: bool = False) -> Column:
    return _in(c, ATTEMPT_FINISHED if attempt else JOB_FINISHED)


def is_processed(c: Column | str) -> Column:
    return _in(c, (PROCESSED,))


def is_noop(c: Column | str) -> Column:
    return _in(c, (NOOP,))


def is_skipped(c: Column | str) -> Column:
    return _in(c, (SKIPPED,))


def is_embryo(c: Column | str) -> Column:
    return _in(c, (EMBRYO,))


def is_in_progress(c: Column | str) -> Column:
    return _in(c, (IN_PROGRESS,))


def is_final_run(c: Column | str) -> Column:
    return _in(c, (FINAL_RUN,))


def is_requested(c: Column | str) -> Column:
    return _in(c, (REQUESTED,))


def is_canceled(c: Column | str) -> Column:
    return _in(c, (CANCELED,))


def is_invalid(c: Column | str) -> Column:
    return _in(c, (INVALID,))


def wanted_states(
    *, running: bool = False, processed: bool = False, noop: bool = False, failed: bool = False, attempt: bool = False
) -> list[str]:
    """States a set of report flags selects."""
    states: list[str] = []
    if processed:
        states.append(PROCESSED)
    if running:
        states += [IN_PROGRESS, REQUESTED] if attempt else [IN_PROGRESS, EMBRYO, FINAL_RUN]
    if failed:
        states += [CANCELED, INVALID] if attempt else [SKIPPED]
    if noop:
        states.append(NOOP)
    return states


def terminal_state(attempt_state: Column | str, job_state: Column | str) -> Column:
    """State a job takes from its attempt: finished attempts decide, all others leave it alone."""
    a = F.col(attempt_state) if isinstance(attempt_state, str) else attempt_state
    j = F.col(job_state) if isinstance(job_state, str) else job_state
    return (
        F.when(a == PROCESSED, F.lit(PROCESSED))
        .when(a == NOOP, F.lit(NOOP))
        .when(a == CANCELED, F.lit(SKIPPED))
        .otherwise(j)
    )
