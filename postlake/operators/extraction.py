"""The whole step from pending postings and replies to roles and runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.operators.adapt import adapt_boards
from postlake.operators.keys import PENDING_ORDER, pending
from postlake.operators.quality import check_roles
from postlake.operators.replies import validate_replies
from postlake.operators.roles import classify, fan_out, persist
from postlake.operators.totals import Totals
from postlake.session import cut_lineage

#: What a reply cost, where that is known.
COSTS = ("tokens_in", "tokens_out", "requests")


def replies_to(postings: DataFrame, replies: DataFrame, key="raw_posting_id") -> DataFrame:
    """Replies to these postings. Keep this ahead of the checks: replies to others reach no outcome, and a check costs far more than a key."""
    return replies.join(postings.select(key).distinct(), key, "left_semi")


def outcomes_of(adapted: DataFrame, checked: DataFrame) -> DataFrame:
    """Postings that were attempted, with what became of them, and the checked ``reply`` behind it.

    A posting neither skipped nor answered yet has no outcome and stays pending. Replies that come without
    ``tokens_in``, ``tokens_out`` or ``requests`` cost none.
    """
    costs = [(F.col(c) if c in checked.columns else F.lit(0)).cast("bigint").alias(c) for c in COSTS]
    replies = checked.select("raw_posting_id", "model", F.col("error").alias("reply_error"), "reasons", "doc_type", "roles",
                             *costs, F.struct(*checked.columns).alias("reply"))
    base = adapted.select("raw_posting_id", "prefilter", "adapter_error")
    done = base.join(replies, "raw_posting_id", "left").filter(
        F.col("prefilter").isNotNull() | F.col("adapter_error").isNotNull() | F.col("reasons").isNotNull())
    return classify(done).withColumns({c: F.coalesce(c, F.lit(0)) for c in COSTS})


def settle(adapted: DataFrame, checked: DataFrame, vocabularies=None, totals: Totals | None = None):
    """(outcomes, roles, rejected roles) of the attempted postings, each worked out and written down once.

    Replies are read and asked for once: roles come from the stored outcomes. ``totals`` (of ``run_totals``) are
    gathered by the write of the outcomes.

    A posting stands or falls as a whole: with one role that breaks a rule it is ``invalid``, the rules are
    its error, and all its roles are rejected.
    """
    tried = cut_lineage(outcomes_of(adapted, checked))
    usable = tried.filter("status = 'ok' AND model <> 'prefilter'").select("reply.*")
    rows = cut_lineage(check_roles(fan_out(usable, vocabularies)))
    told = F.transform("reason", lambda r: F.concat(F.lit("role "), F.col("role_index"), F.lit(": "), r))
    broken = rows.filter(F.size("reason") > 0).groupBy("raw_posting_id").agg(
        F.array_join(F.array_sort(F.flatten(F.collect_list(told))), "; ").alias("broken"))
    fell = F.col("broken").isNotNull()
    outcomes = tried.drop("reply", "reasons", "roles").join(broken, "raw_posting_id", "left").withColumns({
        "status": F.when(fell, "invalid").otherwise(F.col("status")),
        "error": F.when(fell, F.substring("broken", 1, vocab.ERROR_CHARS)).otherwise(F.col("error")),
        "doc_type": F.when(~fell, F.col("doc_type")),
        "role_count": F.when(fell, 0).otherwise(F.col("role_count"))}).drop("broken")
    names = broken.select("raw_posting_id")
    outcomes = cut_lineage(totals.on(outcomes) if totals else outcomes)
    return (outcomes, rows.join(names, "raw_posting_id", "left_anti").drop("reason"),
            rows.join(names, "raw_posting_id", "left_semi"))


def process(raw: DataFrame, runs: DataFrame, roles: DataFrame, replies: DataFrame, as_of,
            sources=None, limit=None, vocabularies=None, totals: Totals | None = None, order=PENDING_ORDER):
    """Next (roles, runs, rejected roles) from the replies to pending postings.

    ``replies`` is a table of replies, or a function from the adapted postings that are to be asked to one, as
    ``partial(score, load=..., name=...)``; it sees no posting that is skipped or cannot be read.
    """
    work = pending(raw, runs, sources, limit, order=order)
    if callable(replies):
        adapted = cut_lineage(adapt_boards(work), "adapted")  # read by the model, and then beside its replies
        replies = replies(adapted.filter("prefilter IS NULL AND adapter_error IS NULL"))
    else:
        adapted, replies = adapt_boards(work), replies_to(work, replies)
    outcomes, good, bad = settle(adapted, validate_replies(replies), vocabularies, totals)
    next_roles, next_runs = persist(roles, runs, good, outcomes, as_of)
    return next_roles, next_runs, bad
