"""Gates, their dispositions and order, job states and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Terminal classes and the process exit code of each; a usage error exits with 2.
EXIT_CODES = {
    "success": 0, "internal-failure": 1, "invalid-input": 3, "ingestion-failure": 10, "baseline-build-failure": 11, "correctness-failure": 12, "benchmark-ineligible": 13,
    "analysis-failure": 20, "materialization-failure": 21, "candidate-failure": 22, "no-eligible-champion": 23, "replay-mismatch": 24, "resource-failure": 70, "interrupted": 130,
}
#: Any other class.
OTHER_EXIT = 1
SOFT_TERMINALS = ("none", "success", "candidate-rejected")


def gate_disposition(unavailable: Column, policy: Column, cleanup: Column, resource: Column, timeout: Column, signal: Column, exit_code: Column) -> Column:
    """The first that applies, in this order; then a non-zero exit code; else passed."""
    return (
        F.when(unavailable, "unavailable")
        .when(policy, "policy-violation")
        .when(cleanup, "cleanup-failure")
        .when(resource, "resource-limit")
        .when(timeout, "timeout")
        .when(signal, "signaled")
        .when(exit_code != 0, "failed")
        .otherwise("passed")
    )


def outcome_consistent(flags: list[Column], exit_code: Column, output_bytes: Column, limit: int) -> Column:
    """At most one terminal flag, the exit code in 0..255 (0 with any flag), the output within its bound."""
    n = sum((f.cast("int") for f in flags), F.lit(0))
    return (n <= 1) & exit_code.between(0, 255) & ((n == 0) | (exit_code == 0)) & output_bytes.between(0, limit)


def gate_selected(stage: Column, finalist_requested: Column) -> Column:
    return (stage == "fast") | ((stage == "finalist") & finalist_requested)


def gate_sequence(gates: DataFrame, subject: str, order: list[str], passed: Column, required: Column) -> DataFrame:
    """State of each gate in declared order: after a required gate failed, the rest are not run."""
    w = Window.partitionBy(subject).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.when(required & ~passed, 1).otherwise(0)).over(w) == 1, F.lit(False))
    return gates.withColumn("state", F.when(stopped, "not-run").when(passed, "passed").otherwise("failed"))


def eligibility(states: DataFrame, subject: str, required: Column) -> DataFrame:
    """Whether all required gates passed, the first failure, and how many ran."""
    return states.groupBy(subject).agg(
        F.bool_and(~required | (F.col("state") == "passed")).alias("performance_eligible"),
        F.count_if(F.col("state") != "not-run").alias("gates_run"),
        F.count_if(F.col("state") == "failed").alias("gates_failed"),
    )


def exit_code(terminal: Column) -> Column:
    out = F.lit(OTHER_EXIT)
    for name, code in EXIT_CODES.items():
        out = F.when(terminal == name, code).otherwise(out)
    return out.cast("long")


def is_hard_failure(terminal: Column) -> Column:
    return ~terminal.isin(*SOFT_TERMINALS)


def job_waves(jobs: DataFrame, run: str, index: str, terminal: str, workers: int) -> DataFrame:
    """State of each job when waves of `workers` jobs run one after the other.

    A hard failure cancels the rest of its wave; later waves never start; then
    nothing commits.  A rejected candidate still commits.
    """
    wave = F.floor(F.col(index) / workers).cast("long")
    rows = jobs.withColumn("wave", wave).withColumn("_hard", is_hard_failure(F.col(terminal)))
    first_wave = F.min(F.when(F.col("_hard"), F.col("wave"))).over(Window.partitionBy(run))
    first_index = F.min(F.when(F.col("_hard"), F.col(index))).over(Window.partitionBy(run))
    state = (
        F.when(first_wave.isNull(), "committed")
        .when(F.col("wave") > first_wave, "not-started")
        .when(F.col("wave") < first_wave, "discarded")
        .when(F.col(index) == first_index, "failed")
        .when(F.col("_hard"), "failed")
        .otherwise("canceled")
    )
    return rows.withColumn("state", state).drop("_hard")


def schedule_counters(rows: DataFrame, run: str, valid: Column, failed: Column) -> DataFrame:
    """validated, invalid, scheduled, failed and committed rows of a run, and the first failure's index."""
    return rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("validated"),
        F.count_if(~valid).alias("invalid"),
        F.count_if(valid).alias("scheduled"),
        F.count_if(valid & failed).alias("failed"),
        F.when(F.count_if(valid & failed) == 0, F.count_if(valid)).otherwise(0).cast("long").alias("committed"),
        F.coalesce(F.min(F.when(valid & failed, F.col("index"))), F.lit(-1)).cast("long").alias("first_failure"),
    )


def rejection(accepted: Column, correct: Column, assured: Column, measured: Column) -> Column:
    """Why a candidate is refused: the first of provider, correctness, assurance, measurement; else none."""
    return F.when(~accepted, "provider").when(~correct, "correctness").when(~assured, "assurance").when(~measured, "measurement").otherwise("none")


def baseline_state(configured: Column, compiled: Column, correct: Column, benchmarked: Column) -> Column:
    """Configure, compile, correctness, benchmark run in order and stop at the first failure."""
    return F.when(~configured | ~compiled, "build-failed").when(~correct, "correctness-failed").when(~benchmarked, "benchmark-ineligible").otherwise("eligible")


# Terminal reasons that a provider may state for a job.
TERMINALS = (
    "none", "success", "candidate-rejected", "start-failed", "timeout", "resource-limit", "signaled", "canceled", "provider-protocol", "cleanup-failed", "capability-unavailable",
)
#: What a recipe's status means for a search: limits and states of their own, everything else is an invalid recipe.
RECIPE_REJECTIONS = {"ok": "none", "resource-limit": "resource-limit", "out-of-memory": "resource-limit", "state": "state"}


def recipe_rejection(status: Column) -> Column:
    out = F.lit("recipe-invalid")
    for name, reason in RECIPE_REJECTIONS.items():
        out = F.when(status == name, reason).otherwise(out)
    return out


def command_disposition(timed_out: Column, exit_code: Column) -> Column:
    return F.when(timed_out, "timeout").when(exit_code != 0, "failed").otherwise("passed")


def gate_records(outcomes: DataFrame) -> DataFrame:
    """Evidence of gates from their recorded outcomes: disposition, and fingerprints as text; empty excerpts are null."""
    c = F.col
    text = lambda name: F.concat(F.lit("fnv1a64-v1:"), F.lower(F.lpad(F.hex(c(name)), 16, "0"))).alias(name)
    kind = gate_disposition(c("unavailable"), c("policy_violation"), c("cleanup_failure"), c("resource_limit"), c("timed_out"), c("signal") != 0, c("exit_code"))
    prints = ("stdout_fingerprint", "stderr_fingerprint", "toolchain_fingerprint")
    rest = [x for x in outcomes.columns if x not in (*prints, "excerpt")]
    return outcomes.select(*rest, *map(text, prints), F.when(c("excerpt") != "", c("excerpt")).alias("excerpt"), kind.alias("disposition"))


def polled_terminal(polls: DataFrame, job: list[str], limit: int) -> DataFrame:
    """The terminal reason of each job from its recorded polls(job, round, terminal boolean, reason), by round.

    The first poll that ends the job counts: one that is terminal without a
    reason, or has a reason without being terminal, breaks the protocol; so does
    a job that no poll of the first `limit` rounds ended.
    """
    ending = F.col("terminal") | (F.col("reason") != "none")
    reason = F.when(F.col("terminal") & (F.col("reason") != "none"), F.col("reason")).otherwise("provider-protocol")
    seen = polls.where(F.col("round") < limit).groupBy(*job).agg(F.min_by(F.when(ending, reason), F.when(ending, F.col("round"))).alias("_reason"))
    return polls.select(*job).distinct().join(seen, job, "left").select(*job, F.coalesce("_reason", F.lit("provider-protocol")).alias("terminal"))


def joined_state(started: Column, polled: Column, joined: Column, cleaned: Column, cancel_requested: Column, capable: Column, evaluated: Column) -> tuple[Column, Column]:
    """(terminal reason, state) of a job after its provider was joined.

    Without cleanup nothing else counts.  A join that contradicts the polls
    breaks the protocol, unless a cancel was asked for and met; then missing
    capabilities, then a success without an evaluation that can be used.
    """
    agreed = (joined == polled) | (cancel_requested & (joined == "canceled"))
    reason = (
        F.when(~started, polled)
        .when(~cleaned, "cleanup-failed")
        .when(~capable, "capability-unavailable")
        .when(~agreed, "provider-protocol")
        .when((polled == "success") & ~evaluated, "provider-protocol")
        .otherwise(polled)
    )
    state = F.when(~started, "not-started").when(~cleaned, "cleanup-failed").when(is_hard_failure(reason), "joined").otherwise("staged")
    return reason, state


def provider_available(kind: Column, sandbox: Column, compiler: Column) -> Column:
    """Whether a registered provider can run: all need the sandbox, those that read or compile source the compiler too."""
    return F.when(kind == "execution", sandbox).when(kind.isin("analysis", "syntax-tree", "evaluation"), sandbox & compiler).otherwise(F.lit(False))


def identity_valid(value: Column, limit: int = 63) -> Column:
    """A fingerprint or identity that an outcome may carry: not empty and within the limit."""
    return F.coalesce(F.octet_length(value).between(1, limit), F.lit(False))


def started_wave(jobs: DataFrame, index: str, workers: int, wave: int, refused: Column) -> DataFrame:
    """The jobs of a wave after it was started: those whose provider refused end at once, the others run."""
    mine = jobs.where(F.floor(F.col(index) / workers) == wave)
    return mine.withColumn("started", ~refused).withColumn("terminal", F.when(refused, "start-failed").otherwise("none")).withColumn("state", F.when(refused, "terminal").otherwise("started"))
