"""Names of metric columns, models, runs and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and patterns in task names.
BPB = ":bpb"
MULTIPLE_CHOICE = ":mc($|:)"
RANKED_CHOICE = ":rc($|:)"
SUITE_SUFFIX = "(::.+)$"
PASS_AT = ":pass_at_"
# Number of hash characters that tell apart configurations of a task without an alias.
ALIAS_HASH_CHARS = 6
# Last folder of a checkpoint path, the run service whose links are accepted, and the
# length and ending of short labels.
STEP_FOLDER = r"/step[0-9]+[^/]*/?$"
RUN_HOST = "wandb.ai"
LABEL_CHARS = 30
LABEL_END = "..."


def bpb_name(alias: Column) -> Column:
    """Name of the bits-per-byte column of a task, null where it must not have one."""
    has_none = alias.contains(BPB) | alias.rlike(MULTIPLE_CHOICE)
    return F.when(
        ~has_none,
        F.when(alias.rlike(RANKED_CHOICE), F.regexp_replace(alias, RANKED_CHOICE, f"{BPB}$1"))
        .when(alias.rlike(SUITE_SUFFIX), F.regexp_replace(alias, SUITE_SUFFIX, f"{BPB}$1"))
        .otherwise(F.concat(alias, F.lit(BPB))),
    )


def pass_at_name(alias: Column, k: int) -> Column:
    return F.concat(alias, F.lit(f"{PASS_AT}{k}"))


def parse_task_config(text: Column) -> Column:
    """The fields of a task's JSON configuration that name and classify it."""
    return F.from_json(text, "metadata struct<alias:string,num_tasks:double>")


def parse_model_config(text: Column) -> Column:
    return F.from_json(text, "model string, revision string")


def task_alias(task: Column, task_config: Column, task_name: Column) -> Column:
    """Alias of a parsed configuration, else the task's name and a short hash of the JSON text.

    The hash is over the stored text: re-serialising JSON would change it.
    """
    digest = F.substring(F.sha2(task_config, 256), 1, ALIAS_HASH_CHARS)
    return F.coalesce(task["metadata"]["alias"], F.concat(task_name, F.lit("-"), digest))


def model_name(model: Column) -> Column:
    """``model`` or ``model:revision``; null when the parsed configuration names no model."""
    return F.when(model["model"].isNotNull(), F.concat_ws(":", model["model"], model["revision"]))


def is_aggregate(task: Column) -> Column:
    """True for records that already summarise several tasks."""
    return F.coalesce(task["metadata"]["num_tasks"], F.lit(0.0)) > 0


def eval_run_name(
    path: Column, bos: bool = False, shots: int | None = None, suffix: str | None = None
) -> Column:
    """Run name of a checkpoint path.

    A last folder ``step<digits>...`` is joined to the folder above it with an underscore.
    """
    bare = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    bare = F.rtrim(bare, F.lit("/"))
    last = F.regexp_extract(bare, r"([^/]*)$", 1)
    above = F.regexp_extract(bare, r"([^/]*)/+[^/]*$", 1)
    name = F.when(path.rlike(STEP_FOLDER), F.concat(above, F.lit("_"), last)).otherwise(last)
    tail = ("_bos" if bos else "") + (f"_s{shots}" if shots is not None else "") + (f"_{suffix}" if suffix else "")
    return F.concat(name, F.lit(tail)) if tail else name


def run_path(text: Column, host: str = RUN_HOST, strict: bool = False) -> Column:
    """``entity/project/id`` from such a path or from a link to the run.

    The id ends at ``/`` or ``?``. Other text is kept, or fails the query when ``strict``.
    """
    path = F.btrim(text, F.lit("/"))
    url = rf"^https?://{host}/([^/]+)/([^/]+)/runs/([^/?]+)"
    other = (
        F.raise_error(F.concat(F.lit("not a run path: "), path)).cast("string") if strict else path
    )
    return (
        F.when(path.rlike(r"^[^/]+/[^/]+/[^/]+$"), path)
        .when(path.rlike(url), F.concat_ws("/", *(F.regexp_extract(path, url, i) for i in (1, 2, 3))))
        .otherwise(other)
    )


def short_label(text: Column, limit: int = LABEL_CHARS) -> Column:
    """Longer labels are cut, so that they are ``limit`` characters long with their ending."""
    head = F.substring(text, 1, limit - len(LABEL_END))
    return F.when(F.length(text) > limit, F.concat(head, F.lit(LABEL_END))).otherwise(text)
