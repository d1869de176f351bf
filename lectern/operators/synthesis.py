"""Prompts, and text generation with a caller-supplied function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.sizing import staged
from lectern.rules import ALWAYS, DEFAULT_MODE, MODE_INSTRUCTIONS

Generate = Callable[[Sequence[str]], Sequence[str]]

# Headings of a prompt's sections.
PASSAGES = "[Texts]"
QUESTION = "[Question]"
REPORT = "[Reply]"
TASK = "[Step]"
VALUES = "[Lists]"
WARNINGS = "[Notes]"
SHARE = "[Texts, share %d of %d]"
LAST_SHARE = "[Texts, last share: %d of %d]"
EARLIER = "[Written about shares 1 to %d]"
SHARE_TEXT = "(Share %d)\n"

ASK_DISTRIBUTION = "Say how the documents are spread over the values, and keep all counts and shares."
ASK_SINGLE = "Keep it short, with marks like [Source 1]."
ASK_WHOLE = "Begin with the outcome, then give the grounds."
ASK_PART = "Note what this share says about the question. The notes on all shares are put together later."
ASK_FINAL = "Put the notes and the last share together into one text, with marks like [Source 1]."
TOLD_PART = "The texts come in %2$d shares; this is number %1$d."
PASS_ON = "\nPass these notes on."
# Fixed value: what stands between the answers of a question's parts.
BETWEEN_PARTS = "\n\n---\n\n"


def instructions(mode: Column) -> Column:
    """What the mode asks for; unknown modes read as ``answer``."""
    pairs = [x for m, text in MODE_INSTRUCTIONS.items() for x in (F.lit(m), F.lit(text))]
    asked = F.coalesce(F.try_element_at(F.create_map(*pairs), mode), F.lit(MODE_INSTRUCTIONS[DEFAULT_MODE]))
    return F.concat_ws(" ", asked, F.lit(ALWAYS))


def warnings_block(notes: Column) -> Column:
    lines = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n")
    block = F.concat(F.lit(f"\n\n{WARNINGS}\n"), lines, F.lit(PASS_ON))
    return F.when(F.size(notes) > 0, block).otherwise(F.lit(""))


def _section(head: Column | str, body: Column) -> Column:
    return F.concat(F.lit(head) if isinstance(head, str) else head, F.lit("\n"), body)


def _prompt(*sections: Column) -> Column:
    return F.concat_ws("\n\n", *sections)


def distribution_prompt(mode: Column, values: Column, query: Column) -> Column:
    return _prompt(
        instructions(mode), _section(VALUES, values), _section(QUESTION, query),
        _section(REPORT, F.lit(ASK_DISTRIBUTION)),
    )


def single_prompt(mode: Column, context: Column, query: Column) -> Column:
    return _prompt(
        instructions(mode), _section(PASSAGES, context), _section(QUESTION, query),
        _section(REPORT, F.lit(ASK_SINGLE)),
    )


def _no_notes() -> Column:
    return F.array().cast("array<string>")


def chunk_prompt(
    mode: Column, chunk: Column, query: Column, no: Column, n: Column, earlier: Column, notes: Column | None = None
) -> Column:
    """Prompt of chunk ``no`` of ``n``: a whole report, a part, or the final joining of ``earlier`` parts."""
    warned = F.concat(instructions(mode), warnings_block(_no_notes() if notes is None else notes))
    part_head = F.format_string(SHARE, no, n)
    last_head = F.format_string(LAST_SHARE, no, n)
    earlier_head = F.format_string(EARLIER, n - 1)
    whole = _prompt(warned, _section(PASSAGES, chunk), _section(QUESTION, query), _section(REPORT, F.lit(ASK_WHOLE)))
    part = _prompt(
        instructions(mode),
        F.format_string(TOLD_PART, no, n),
        _section(part_head, chunk), _section(QUESTION, query), _section(TASK, F.lit(ASK_PART)),
    )
    final = _prompt(
        warned, _section(earlier_head, earlier), _section(last_head, chunk),
        _section(QUESTION, query), _section(TASK, F.lit(ASK_FINAL)),
    )
    return F.when(n == 1, whole).when(no < n, part).otherwise(final)


def extract(prompts: Sequence[str]) -> list[str]:
    """Offline default generator: the first sentence of every passage, or the value list as it is."""
    out = []
    for prompt in prompts:
        body = prompt.split(f"\n\n{QUESTION}", 1)[0]
        if VALUES in body:
            out.append(body.split(VALUES, 1)[1].strip())
            continue
        cited = re.findall(r"(\[Source \d+\]) \(score: [^)]*\)\n(.*?)(?=\n\n\[Source |\Z)", body, flags=re.S)
        lines = [f"{re.split(r'(?<=[.!?])[ \n]', text.strip(), maxsplit=1)[0]} {mark}" for mark, text in cited]
        out.append("\n".join(lines))
    return out


def generate_text(prompts: DataFrame, generate: Generate | None = None, out: str = "answer") -> DataFrame:
    """Adds the generated text of ``prompt``. Only the prompt goes to Python; failures fail the job."""
    generate = generate or extract

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(generate(batch.tolist()), dtype="object")

    # declared non-deterministic so that the optimizer never copies the call
    return prompts.withColumn(out, run.asNondeterministic()(F.col("prompt")))


def build_prompts(chunks: DataFrame, notes: bool = False) -> DataFrame:
    """Prompts of the chunks that need no other chunk's answer: all but the last of several.

    ``chunks`` has ``qid, query, mode, chunk_no, n_chunks, chunk`` and, with ``notes``, ``notes``.
    """
    ready = chunks.where((F.col("n_chunks") == 1) | (F.col("chunk_no") < F.col("n_chunks")))
    return ready.withColumn("prompt", _chunk_prompt(F.lit(""), notes))


def _chunk_prompt(earlier: Column, notes: bool) -> Column:
    return chunk_prompt(
        F.col("mode"), F.col("chunk"), F.col("query"), F.col("chunk_no"), F.col("n_chunks"),
        earlier, F.col("notes") if notes else None,
    )


def synthesize(chunks: DataFrame, generate: Generate | None = None, notes: bool = False) -> DataFrame:
    """``qid, answer`` from chunked contexts.

    First all independent chunks of all questions at once, then the last chunk of
    each question with the earlier answers before it. Up to three answers are
    joined; of more only the last counts, as it covers the others.
    """
    first = generate_text(build_prompts(chunks, notes), generate)
    first = staged(first.select("qid", "chunk_no", "n_chunks", "answer"), "parts")
    done = first.where("n_chunks = 1").select("qid", "answer")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "answer")))
    earlier = first.where("n_chunks > 1").groupBy("qid").agg(parts.alias("parts"))
    marked = F.transform(
        "parts", lambda p: F.concat(F.format_string(SHARE_TEXT, p["chunk_no"]), p["answer"])
    )
    last = chunks.where("n_chunks > 1 and chunk_no = n_chunks").join(earlier, "qid")
    final = generate_text(last.withColumn("prompt", _chunk_prompt(F.array_join(marked, "\n\n"), notes)), generate)
    joined = F.concat_ws(BETWEEN_PARTS, F.transform("parts", lambda p: p["answer"]), F.col("answer"))
    merged = F.when(F.col("n_chunks") <= 3, joined).otherwise(F.col("answer"))
    return done.unionByName(final.select("qid", merged.alias("answer")))
