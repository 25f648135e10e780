"""Prompt text: user content, message arrays, chat and Alpaca renderings and their parser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunetable.functions.text import as_column, or_empty, strip

# Texts that must be equal byte for byte for the rendered rows to match.
SYSTEM_PROMPT = (
    "You are an expert Python programmer. Write clean, efficient, well-documented, and "
    "idiomatic Python code. Always include type hints and docstrings for functions."
)
INPUT_SECTION = "\n\nInput:\n"
ALPACA_INSTRUCTION = "### Instruction:\n"
ALPACA_RESPONSE = "### Response:\n"


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around the turns of a conversation.

    A system message opens the instruction block of the user message that follows it.
    """

    start: str = "<s>"
    open_instruction: str = "[INST] "
    close_instruction: str = "[/INST]"
    after_system: str = "\n\n"
    before_answer: str = " "
    after_answer: str = "</s>"


DEFAULT_TEMPLATE = ChatTemplate()


def user_content(instruction: Column | str, input_: Column | str) -> Column:
    """Instruction, followed by an ``Input:`` section when ``input_`` is not empty."""
    given = or_empty(input_)
    return F.concat(
        as_column(instruction),
        F.when(given != "", F.concat(F.lit(INPUT_SECTION), given)).otherwise(""),
    )


Turns = list[tuple[str, Column]]


def turns(
    user: Column, answer: Column | None = None, system: str | None = SYSTEM_PROMPT
) -> Turns:
    """(role, content) of a single exchange: [system,] user [, assistant]."""
    out = [] if system is None else [("system", F.lit(system))]
    out.append(("user", user))
    if answer is not None:
        out.append(("assistant", answer))
    return out


def messages(exchange: Turns) -> Column:
    """The exchange as an array of (role, content) structs."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in exchange])


def render_turn(
    role: Column, content: Column, previous_role: Column, template: ChatTemplate = DEFAULT_TEMPLATE
) -> Column:
    """Text of one turn, given the role of the turn before it (null for the first)."""
    opening = F.when(previous_role.eqNullSafe(F.lit("system")), "").otherwise(
        template.open_instruction
    )
    return (
        F.when(role == "system", F.concat(opening, content, F.lit(template.after_system)))
        .when(role == "user", F.concat(opening, content, F.lit(template.close_instruction)))
        .otherwise(
            F.concat(F.lit(template.before_answer), content, F.lit(template.after_answer))
        )
    )


def render_exchange(exchange: Turns, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """Training text of an exchange whose roles are known; ending with the user turn it is the
    generation prompt. A plain concatenation, so it stays in generated code."""
    pieces, previous = [F.lit(template.start)], None
    for role, text in exchange:
        opening = "" if previous == "system" else template.open_instruction
        before, after = {
            "system": (opening, template.after_system),
            "user": (opening, template.close_instruction),
            "assistant": (template.before_answer, template.after_answer),
        }[role]
        pieces += [F.lit(before), text, F.lit(after)]
        previous = role
    return F.concat(*pieces)


def render_turns(msgs: str, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """Turns of an ordered message array column of any length, without the text start marker."""
    pieces = F.transform(
        msgs,
        lambda m, i: render_turn(m["role"], m["content"], F.get(msgs, i - 1)["role"], template),
    )
    return F.array_join(pieces, "")


def render_alpaca(instruction: Column | str, response: Column | str | None = None) -> Column:
    parts = [F.lit(ALPACA_INSTRUCTION), as_column(instruction), F.lit("\n\n" + ALPACA_RESPONSE)]
    if response is not None:
        parts.append(as_column(response))
    return F.concat(*parts)


def parse_alpaca(text: Column | str) -> dict[str, Column]:
    """Columns ``prompt``, ``expected``, ``instruction`` and ``has_marker`` of an Alpaca text."""
    pieces = F.split(as_column(text), ALPACA_RESPONSE, -1)
    prompt = F.concat(F.get(pieces, F.lit(0)), F.lit(ALPACA_RESPONSE))
    without_header = F.replace(prompt, F.lit(ALPACA_INSTRUCTION), F.lit(""))
    return {
        "prompt": prompt,
        "expected": F.coalesce(F.get(pieces, F.lit(1)), F.lit("")),
        "instruction": F.replace(without_header, F.lit("\n\n" + ALPACA_RESPONSE), F.lit("")),
        "has_marker": F.size(pieces) > 1,
    }


def format_columns(
    instruction: Column | str = "instruction",
    input_: Column | str = "input",
    output: Column | str = "output",
    system: str | None = SYSTEM_PROMPT,
    template: ChatTemplate = DEFAULT_TEMPLATE,
) -> dict[str, Column]:
    """The four columns of a prepared row: stripped fields plus the rendered text."""
    instr = strip(or_empty(instruction))
    given = or_empty(input_)
    answer = strip(or_empty(output))
    text = render_exchange(turns(user_content(instr, given), answer, system), template)
    return {"instruction": instr, "input": given, "output": answer, "text": text}
