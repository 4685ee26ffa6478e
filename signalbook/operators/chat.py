"""Chat records: validation, turn extraction, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.functions.text import strip

CHAT_ROLES = ["system", "user", "assistant"]


def _roles(messages) -> Column:
    return F.transform(messages, lambda m: m["role"])


def chat_issue(messages: Column) -> Column:
    """First violated rule of the strict three-message form as text; null when valid."""
    roles = _roles(messages)
    shown = F.array_join(
        F.transform(roles, lambda r: F.coalesce(F.concat(F.lit("'"), r, F.lit("'")), F.lit("None"))), ", "
    )
    expected = F.array(*[F.lit(r) for r in CHAT_ROLES])
    filled = F.forall(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return (
        F.when(messages.isNull(), F.lit("messages length=missing"))
        .when(F.size(messages) != 3, F.concat(F.lit("messages length="), F.size(messages).cast("string")))
        .when(~F.coalesce(roles == expected, F.lit(False)), F.concat(F.lit("wrong roles: ["), shown, F.lit("]")))
        .when(~filled, F.lit("empty content"))
    )


def validate_chat(df: DataFrame) -> DataFrame:
    return df.withColumn("issue", chat_issue(F.col("messages")))


def validate_roles(df: DataFrame) -> DataFrame:
    """Relaxed form: a user and an assistant message occur somewhere."""
    roles = _roles(F.col("messages"))
    ok = F.array_contains(roles, "user") & F.array_contains(roles, "assistant")
    return df.withColumn("roles_ok", F.coalesce(ok, F.lit(False)))


def _of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def question(messages: Column) -> Column:
    """Stripped content of the first user message; empty text without one."""
    return F.coalesce(strip(F.get(_of_role(messages, "user"), F.lit(0))["content"]), F.lit(""))


def last_user(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(_of_role(messages, "user"), F.lit(-1))["content"], F.lit(""))


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant message; null without one."""
    return F.try_element_at(_of_role(messages, "assistant"), F.lit(-1))["content"]


def last_assistant_index(messages: Column) -> Column:
    """Zero-based index of the last assistant message; null without one."""
    back = F.array_position(F.reverse(_roles(messages)), "assistant")
    return F.when(back > 0, F.size(messages) - back)


def with_answer(messages: Column, text: Column) -> Column:
    """Messages with the content of the last assistant message replaced."""
    at = last_assistant_index(messages)
    swapped = F.transform(
        messages,
        lambda m, i: F.struct(m["role"].alias("role"), F.when(i == at, text).otherwise(m["content"]).alias("content")),
    )
    return F.when(at.isNull(), messages).otherwise(swapped)


def to_chat(df: DataFrame, system: str, instruction="instruction", response="response", category="category") -> DataFrame:
    """Wrap question-answer pairs as three-message chats with a fixed system prompt."""
    label = F.coalesce(F.col(category), F.lit("general")) if category in df.columns else F.lit("general")

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    chat = F.array(
        message("system", F.lit(system)), message("user", F.col(instruction)), message("assistant", F.col(response))
    )
    return df.withColumns({"messages": chat, "category": label})


def to_messages_only(df: DataFrame) -> DataFrame:
    return df.select("messages")


def accept_pairs(df: DataFrame, q="question", a="answer", min_answer: int = 100) -> DataFrame:
    """Generated pairs that hold both fields and an answer longer than ``min_answer``."""
    return df.filter(F.col(q).isNotNull() & (F.length(a) > min_answer))


def keep_category(df: DataFrame, category: str) -> DataFrame:
    return df.filter(F.col("category") == category)
