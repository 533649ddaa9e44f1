"""Record filters, validators, classification and projections.

Each takes and returns a DataFrame (or Columns), adds no shuffle unless it
says so, and keeps columns it doesn't know. Null counts as '' unless stated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveworks.functions.text import is_blank, sanitize, strip, wrap_think

PROVENANCE = ("_source_file", "_source_line", "_sampled")

# --- filters -----------------------------------------------------------------------------------------


def min_length(df: DataFrame, column: str = "input", least: int = 100) -> DataFrame:
    """Rows whose text has at least ``least`` characters; null has none."""
    return df.filter(F.length(F.coalesce(F.col(column), F.lit(""))) >= least)


def consistent(df: DataFrame, left: str = "output", right: str = "output_model") -> DataFrame:
    """Rows where both texts are equal after stripping; two nulls are equal."""
    return df.filter(sanitize(F.col(left)) == sanitize(F.col(right)))


def first_mismatches(df: DataFrame, order: Sequence[str], k: int = 5, left: str = "output", right: str = "output_model") -> DataFrame:
    """The first ``k`` rows, by ``order``, that ``consistent`` drops."""
    return df.filter(sanitize(F.col(left)) != sanitize(F.col(right))).orderBy(*order).limit(k)


def drop_reason(reasoning: str = "reasoning", output: str = "output") -> Column:
    """Why a record is dropped: ``empty_reasoning`` (exactly ''), then ``unknown_output``; null where it is kept. A null reasoning is kept."""
    unknown = F.lower(sanitize(F.col(output))) == "unknown"
    return F.when(F.col(reasoning) == "", F.lit("empty_reasoning")).when(unknown, F.lit("unknown_output"))


def known_and_reasoned(df: DataFrame) -> DataFrame:
    return df.filter(drop_reason().isNull())


def is_valid(required: Sequence[str] = ("instruction", "input"), drop_empty_output: bool = False, output: str = "output") -> Column:
    """Required fields, and on demand the output, have something in them."""
    fields = [*required, *([output] if drop_empty_output else [])]
    out = F.lit(True)
    for f in fields:
        out = out & ~is_blank(F.col(f))
    return out


def needs_generation(overwrite: bool = False, reasoning: str = "reasoning", output: str = "output_model") -> Column:
    return F.lit(True) if overwrite else (is_blank(F.col(reasoning)) | is_blank(F.col(output)))


def precheck_reason(
    required: Sequence[str] = ("instruction", "input", "output"), prompt_len: Column | None = None, total_len: Column | None = None, status: Column | None = None
) -> Column:
    """First failure of a record: ``invalid_json`` and ``not_object`` (by the status of its line), ``missing_fields:a,b`` (null), ``empty_required_field``
    (blank), ``tokenize_error`` (no lengths), ``truncated_prompt_only``; ``ok`` otherwise."""
    missing = F.concat_ws(",", *[F.when(F.col(f).isNull(), F.lit(f)) for f in required])
    blank = F.lit(False)
    for f in required:
        blank = blank | is_blank(F.col(f))
    out = F.when(F.lit(False) if status is None else status == "invalid", F.lit("invalid_json"))
    if status is not None:
        out = out.when(status == "not_object", F.lit("not_object"))
    out = out.when(missing != "", F.concat(F.lit("missing_fields:"), missing)).when(blank, F.lit("empty_required_field"))
    if prompt_len is not None and total_len is not None:
        out = out.when(prompt_len.isNull() | total_len.isNull(), F.lit("tokenize_error")).when(prompt_len >= total_len, F.lit("truncated_prompt_only"))
    return out.otherwise(F.lit("ok"))


def not_empty(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Rows whose text has a character; null has none."""
    return df.filter(F.length(F.col(column)) > 0)


def first_examples(df: DataFrame, group: str, order: Sequence[str], k: int = 3) -> DataFrame:
    """The first ``k`` rows of each group, by ``order``; Spark keeps k a group in each task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("example_rank", rank).filter(F.col("example_rank") <= k)


def preference_fits(df: DataFrame, max_source: int = 2048, max_target: int = 512) -> DataFrame:
    """Pairs whose prompt with either answer has 1 to ``max_source + max_target`` characters; expects ``prompt``."""
    both = [F.length(F.concat(F.coalesce("prompt", F.lit("")), F.coalesce(c, F.lit("")))) for c in ("response_chosen", "response_rejected")]
    return df.filter(both[0].between(1, max_source + max_target) & both[1].between(1, max_source + max_target))


def absent_from(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the other set lacks; null keys are in no set."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def new_vocabulary(base: DataFrame, domains: Mapping[str, DataFrame], frequent: DataFrame | None = None, top: int = 0) -> DataFrame:
    """(piece, origin) of what is added to a base vocabulary: each domain's pieces that neither the base nor an earlier domain has, then of the ``top`` most frequent words (piece, freq) those still new."""
    known = base.select("piece").filter("piece is not null").distinct()
    parts = []
    for name, pieces in domains.items():
        fresh = absent_from(pieces.select("piece").filter("piece is not null").distinct(), known, ["piece"])
        parts.append(fresh.withColumn("origin", F.lit(name)))
        known = known.union(fresh)
    if frequent is not None:
        head = frequent.filter("piece is not null").orderBy(F.desc("freq"), "piece").limit(top).select("piece").distinct()
        parts.append(absent_from(head, known, ["piece"]).withColumn("origin", F.lit("frequent")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def selected_tasks(tasks: Sequence[str], names: str = "", suite: Sequence[str] = (), first: int = 0) -> list[str]:
    """Tasks to run, in their own order: those named, else those of a suite, else the first few (0: all)."""
    wanted = [n.strip() for n in names.split(",") if n.strip()] or list(suite)
    if wanted:
        return [t for t in tasks if t in wanted]
    return list(tasks[:first] if first > 0 else tasks)


def without_files(df: DataFrame, words: Sequence[str], file: str = "_source_file") -> DataFrame:
    """Rows whose file's name has none of the words; a null name has none."""
    name = F.lower(F.coalesce(F.col(file), F.lit("")))
    for w in words:
        df = df.filter(~basename(name).contains(w.lower()))
    return df


def require_references(df: DataFrame, reference: str) -> DataFrame:
    """``df``, if a reference has something in it; raises where a judge would have nothing to go by."""
    if df.filter(~is_blank(F.col(reference))).isEmpty():
        raise ValueError(f"no {reference} to judge by")
    return df


def record_key(own: Column, line: Column) -> Column:
    """A record's own id, else its line number as text."""
    return F.coalesce(F.nullif(sanitize(own), F.lit("")), line.cast("string"))


def split_of_file(file: Column) -> Column:
    """What a file's name says: validation, test, else train."""
    name = F.lower(basename(file))
    return F.when(name.rlike("validation|valid|eval"), "validation").when(name.contains("test"), "test").otherwise("train")


def all_files(*parts: DataFrame) -> DataFrame:
    """The union by name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def filled(template: str, **columns: Column) -> Column:
    """A prompt from a template with {name} places; values are stripped, null is ''."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, place, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not place:
            break
        name, end, rest = tail.partition("}")
        if not end or name not in columns:
            raise ValueError(f"no column for {{{name}")
        parts.append(sanitize(columns[name]))
    return F.concat(*parts) if parts else F.lit("")


# --- classification ----------------------------------------------------------------------------------

# Tasks with display name, sampling weight and system prompt.
TASK_DISPLAY = {
    "case_classification": "刑事定性与量刑", "reading_qa": "法律阅读问答", "evidence_qa": "证据支持问答", "mcq": "法律选择题",
    "case_summary": "司法文书摘要", "argument_summary": "法律论证摘要", "other": "其他法律任务",
}
TASK_WEIGHTS = {"case_classification": 1.0, "reading_qa": 1.0, "evidence_qa": 1.0, "mcq": 1.0, "case_summary": 0.7, "argument_summary": 0.7, "other": 0.8}
TASK_SYSTEM = {
    "case_classification": "你是严谨的中文法律助手。请根据案情做定性分析，给出简洁、准确、结构稳定的结论。",
    "reading_qa": "你是严谨的中文法律助手。请只根据给定案件事实回答问题，不扩写无关内容。",
    "evidence_qa": "你是严谨的中文法律助手。请先抓住支持结论的关键事实，再给出简洁答案。",
    "mcq": "你是严谨的中文法律助手。请基于法律规则完成选择题，并保持答案格式稳定。",
    "case_summary": "你是严谨的中文法律助手。请压缩冗长司法文本，只保留事实主线、争议焦点和裁判结果。",
    "argument_summary": "你是严谨的法律摘要助手。请将法律论证提炼为高信息密度的标题或摘要。",
    "other": "你是严谨的法律助手。请依据输入完成任务，保持准确、简洁、格式稳定。",
}
#: The first rule with a hit names the task; (where, words, task).
TASK_RULES = (
    ((("source", "jec-qa"), ("source", "jec_qa"), ("instruction", "选择题")), "mcq"),
    ((("source", "ydlj"), ("instruction", "按步骤提取支持证据")), "evidence_qa"),
    ((("source", "sfzy"), ("instruction", "案情摘要"), ("instruction", "提炼事实焦点")), "case_summary"),
    ((("source", "cail2018"), ("instruction", "罪名"), ("instruction", "刑期")), "case_classification"),
    ((("source", "cail2019"), ("instruction", "找出问题的正确答案")), "reading_qa"),
    ((("file", "briefme"), ("instruction", "section heading")), "argument_summary"),
    ((("file", "casesumm"), ("instruction", "summary")), "case_summary"),
)


def basename(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/]*)\z", 1)


def task_of(source: str = "source", instruction: str = "instruction", file: str = "_source_file", text: str = "input", output: str = "output") -> Column:
    """The task that a record's origin and wording speak of; ``other`` by default."""
    low = {k: F.lower(F.coalesce(F.col(c), F.lit(""))) for k, c in (("source", source), ("instruction", instruction))} | {"file": F.lower(basename(F.col(file)))}
    out: Column | None = None
    for hits, task in TASK_RULES:
        any_hit = F.lit(False)
        for where, word in hits:
            any_hit = any_hit | low[where].contains(word)
        out = F.when(any_hit, F.lit(task)) if out is None else out.when(any_hit, F.lit(task))
    asks = F.lower(F.coalesce(F.col(text), F.lit(""))).contains("question") & ~is_blank(F.col(output))
    return out.when(asks, F.lit("reading_qa")).otherwise(F.lit("other"))


def lookup(mapping: Mapping[str, object], key: Column, default: object = None) -> Column:
    """A small fixed mapping as an expression."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def parse_weights(text: str | None, defaults: Mapping[str, float] = TASK_WEIGHTS) -> dict[str, float]:
    """``'a=1,b=0.5'`` over the defaults; raises where an entry has no '='."""
    out = dict(defaults)
    for part in (text or "").split(","):
        if part.strip():
            name, sign, value = part.partition("=")
            if not sign:
                raise ValueError(f"no '=' in {part!r}")
            out[name.strip()] = float(value)
    return out


# --- projections -------------------------------------------------------------------------------------


def drop_provenance(df: DataFrame) -> DataFrame:
    return df.drop(*PROVENANCE)


def has_provenance(df: DataFrame) -> Column:
    """Whether ``drop_provenance`` changes a row: one of the keys has a value; a null one counts as absent."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in PROVENANCE if c in df.columns], F.lit(False))


def system_text(own: Column, default: str = "", blank_is_none: bool = True) -> Column:
    """A row's own system prompt, stripped, else the default; white space alone is none, or, without ``blank_is_none``, gives ''."""
    none = is_blank(own) if blank_is_none else (F.coalesce(own, F.lit("")) == "")
    return F.when(none, F.lit(default.strip())).otherwise(strip(own))


def items_as_conversations(df: DataFrame, items: str = "items") -> DataFrame:
    """Dialogs that are called ``items`` under their usual name, and nothing else."""
    return df.select(F.col(items).alias("conversations"))


def mixed_instruction(task: Column, instruction: Column) -> Column:
    """The task's display name on a line of its own before the instruction; alone where that is blank."""
    head = F.concat(F.lit("[任务类型] "), lookup(TASK_DISPLAY, task, TASK_DISPLAY["other"]))
    body = sanitize(instruction)
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\n"), body))


def enrich(df: DataFrame, mode: str = "replace") -> DataFrame:
    """Task, dataset, file, system prompt and mixed instruction; ``replace`` also puts the latter in the instruction's place."""
    if mode not in ("replace", "prefix"):
        raise ValueError(mode)
    task = task_of()
    out = df.withColumns(
        {
            "task_name": task,
            "dataset_name": F.coalesce(F.nullif(sanitize(F.col("source")), F.lit("")), basename(F.col("_source_file"))),
            "source_file": F.col("_source_file"),
            "system_prompt": lookup(TASK_SYSTEM, task, TASK_SYSTEM["other"]),
            "mixed_instruction": mixed_instruction(task, F.col("instruction")),
        }
    )
    return out.withColumn("instruction", F.col("mixed_instruction")) if mode == "replace" else out


def _turn(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def alpaca_conversation(instruction: Column, text: Column, output: Column) -> Column:
    """A human turn of the instruction and, if not blank, the unstripped input; a gpt turn of the output."""
    text = F.coalesce(text, F.lit(""))
    human = F.when(is_blank(text), F.coalesce(instruction, F.lit(""))).otherwise(F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n\n"), text))
    return F.array(_turn("human", human), _turn("gpt", F.coalesce(output, F.lit(""))))


def qa_conversation(question: Column, answer: Column) -> Column:
    return F.array(_turn("human", F.coalesce(question, F.lit(""))), _turn("gpt", F.coalesce(answer, F.lit(""))))


def tidied(df: DataFrame, *columns: str) -> DataFrame:
    """Those text columns stripped once, null as '', for ``sft_messages``."""
    return df.withColumns({c: sanitize(F.col(c)) for c in columns})


def sft_messages(system: Column | None = None, include_reasoning: bool = True, tidy: bool = False) -> Column:
    """Chat messages of a record: system if not blank, the user's instruction and input, the assistant's wrapped reasoning and output.
    ``tidy`` tells that ``tidied`` has stripped the columns, so that no text is stripped again in each branch."""
    clean = (lambda c: c) if tidy else sanitize
    user = F.concat_ws("\n", F.nullif(clean(F.col("instruction")), F.lit("")), F.nullif(clean(F.col("input")), F.lit("")))
    answer = clean(F.col("output"))
    if include_reasoning:
        answer = F.when(is_blank(F.col("reasoning")), answer).otherwise(F.concat(wrap_think(F.col("reasoning"), tidy), F.lit("\n"), answer))
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = F.array(say("user", user), say("assistant", answer))
    if system is None:
        return turns
    return F.when(is_blank(system), turns).otherwise(F.concat(F.array(say("system", clean(system))), turns))


def chatml(messages: Column, ask: bool = False) -> Column:
    """Messages as marked text; ``ask`` adds the header of the next answer."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|im_start|>assistant\n" if ask else ""))


def grpo_prompt(only_input: bool = False, question: Column | None = None) -> Column:
    """The prompt of a reward run: instruction and input, or the first of input, question and instruction alone."""
    parts = [F.nullif(sanitize(c), F.lit("")) for c in (F.col("input"), *([question] if question is not None else []))]
    body, instruction = F.coalesce(*parts, F.lit(None).cast("string")), F.nullif(sanitize(F.col("instruction")), F.lit(""))
    return F.coalesce(body, instruction, F.lit("")) if only_input else F.concat_ws("\n\n", instruction, body)


def sharegpt_valid(conversations: Column) -> Column:
    """There is a list, possibly empty, and each turn has a known speaker and a value."""
    good = F.forall(conversations, lambda t: t["from"].isin("system", "human", "gpt") & t["value"].isNotNull())
    return F.coalesce(conversations.isNotNull() & F.coalesce(good, F.lit(False)), F.lit(False))
