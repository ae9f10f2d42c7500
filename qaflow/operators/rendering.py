"""Prompt templates and chat messages as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaflow.functions.strings import strip

#: Bracket tokens of the prompt format.
TOKENS = {k: f"[{k}]" for k in ("context_start", "context_end", "query_start", "query_end", "thinking_start", "thinking_end", "answer_start", "answer_end")}


def bracket_prompt(query: Column, context: Column, opening: str = "answer_start", tokens: dict[str, str] = TOKENS) -> Column:
    """Context and query between their tokens, then the opening token of what the model is to write."""
    t = {k: F.lit(v) for k, v in tokens.items()}
    return F.concat(t["context_start"], context, t["context_end"], t["query_start"], query, t["query_end"], *([t[opening]] if opening else []))


def bracket_text(query: Column, context: Column, answer: Column, tokens: dict[str, str] = TOKENS) -> Column:
    return F.concat(bracket_prompt(query, context, "answer_start", tokens), answer, F.lit(tokens["answer_end"]))


def reasoning_target(thinking: Column, answer: Column, tokens: dict[str, str] = TOKENS) -> Column:
    t = {k: F.lit(v) for k, v in tokens.items()}
    return F.concat(t["thinking_start"], strip(thinking), t["thinking_end"], t["answer_start"], strip(answer), t["answer_end"])


def user_content(query: Column, context: Column, json_mode: bool, idk: str) -> Column:
    """CONTEXT and QUESTION blocks with the closing instruction of the mode."""
    closing = "Return JSON." if json_mode else f"Answer using only CONTEXT. If not in context, reply exactly: {idk}"
    return F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), query, F.lit("\n\n" + closing))


def numbered(passages: Column) -> Column:
    """[1] first, [2] second, ... one to a line."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")


def instruct_content(question: Column, passages: Column, instruction: str, hint: str) -> Column:
    return F.concat(
        F.lit(f"{instruction}\n\nContext:\n"), numbered(passages), F.lit("\n\nQuestion: "), question,
        F.lit(f'\n\nYour answer should be {hint}.\nEnd your response with "Answer:" followed by your final answer.'),
    )


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """array<struct<role, content>> of system, user and, where given and not null, assistant."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [turn("system", system), turn("user", user)]
    if assistant is not None:
        turns.append(F.when(assistant.isNotNull(), turn("assistant", assistant)))
    return F.array_compact(F.array(*turns))


def system_prompt(version: Column, prompts: dict[str, str]) -> Column:
    """The version's prompt; an unknown version is an error."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv]), version)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown prompt version "), F.coalesce(version, F.lit("null")))).cast("string"))


def thinking_cap(version: Column, most: int, caps: dict[str, int] | None = None) -> Column:
    """How many words of thinking a version may have: ``most``, save for versions that ``caps`` names."""
    found = F.lit(None).cast("int")
    for v, n in (caps or {}).items():
        found = F.when(version == v, F.lit(n)).otherwise(found)
    return F.coalesce(found, F.lit(most))
