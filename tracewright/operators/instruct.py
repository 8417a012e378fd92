"""Instructions: rendering features as text, wrapping samples, fan-out over functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import let
from tracewright.operators import transforms as tr

#: Longest chat, in characters, where a cap is wanted.
MAX_CHARS = 12_288
# Texts around instructions that consumers of the samples look for.
NOTES = "\n\n## NOTES\n\nInstructions that you must follow in your reasoning chain (the part of your response before your final answer):\n- "
HEADER = "Thinking Contraints:\n"  # fixed value, spelled as the consumers expect it

#: What an instruction on a feature asks for, and the sentences that ask; a template is a pair of both.
ASKED: dict[str, str] = {
    "palindrome": "these palindromes: {value}",
    "uppercase_word_count": "{value} words in capitals",
    "ngram_repetitions": "these runs of words more than once: {value}",
    "contains_list_or_enumeration": "a beginning {value} an enumeration",
    "common_noun_hypernyms": "several things of the kinds: {value}",
    "paragraph_count": "{value} paragraphs",
    "hidden_acrostic": "the first letters of sentences spelling: {value}",
    "para_starts_with": "paragraphs that begin with: {value}",
    "para_ends_with": "paragraphs that end with: {value}",
    "sent_starts_with": "sentences that begin with: {value}",
    "sent_ends_with": "sentences that end with: {value}",
    "word_count": "{value} words",
    "sentence_count": "{value} sentences",
    "repeated_sentences": "these sentences more than once: {value}",
    "unique_word_count": "{value} different words",
}
WAYS = [
    "Write a text with {what}.", "Let the answer have {what}.", "Answer with {what}.", "The response needs {what}.", "See to it that there are {what}.",
    "Keep to {what}.", "What you write must have {what}.", "Think in a way that gives {what}.", "Compose it with {what}.", "Your text should contain {what}.",
]
#: Default templates per feature; others can be given as a table ``feature, template_no, template``.
TEMPLATES: dict[str, list[str]] = {name: [way.replace("{what}", what) for way in WAYS] for name, what in ASKED.items()}


def template_table(spark, templates: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(k, i, x) for k, xs in (templates or TEMPLATES).items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "feature string, template_no int, template string")


def render(values: DataFrame, templates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Instruction lines per row: ``id, instructions``.

    ``values``: ``id, feature, value string``; true and false become "with"
    and "without"; features without template are left out.  The template is
    chosen by id, the lines are ordered by feature.
    """
    sizes = templates.groupBy("feature").agg(F.count("*").alias("size"))
    shown = F.when(F.col("value") == "true", "with").when(F.col("value") == "false", "without").otherwise(F.col("value"))
    chosen = (
        values.join(F.broadcast(sizes), "feature")
        .withColumn("template_no", F.pmod(F.col(id_col), F.col("size")).cast("int"))
        .join(F.broadcast(templates), ["feature", "template_no"])
        .select(id_col, "feature", F.replace(F.col("template"), F.lit("{value}"), shown).alias("line"))
    )
    lines = F.transform(F.sort_array(F.collect_list(F.struct("feature", "line"))), lambda s: s["line"])
    return chosen.groupBy(id_col).agg(F.array_join(lines, "\n").alias("instructions"))


def with_constraints(question: Column, instructions: Column) -> Column:
    return F.concat(F.lit(HEADER), instructions, F.lit("\n\nQuestion: "), question)


def prefix(description: Column) -> Column:
    """How the reasoning opens by recalling the instruction (a fixed text around it)."""
    return F.concat(
        F.lit("<think>\nOkay, so before I start reasoning, let me recall the user's instructions for my reasoning chain: I must "),
        description,
        F.lit(".\nIt's really important that I adhere to these instructions.\n\n"),
    )


def wrap_sample(user: Column, cot: Column, response: Column, description: Column) -> Column:
    """Messages of a sample whose reasoning follows an instruction."""
    asked = F.concat(user, F.lit(NOTES), description)
    said = F.concat(prefix(description), cot, F.lit("\n</think>\n\n"), response)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("user", asked), message("assistant", said))


def num_chars(messages: Column) -> Column:
    """Length of a chat: its contents and role marks."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + F.length(m["role"]) + F.length(m["content"]))


def reinstruct(user: Column, assistant: Column, description: Column) -> Column:
    """The user turn with another instruction in its notes, and the assistant turn rebuilt where it recalls one more than once."""
    asked = F.concat(F.substring_index(user, "\n\n## NOTES", 1), F.lit(NOTES), description)
    recalls = F.regexp_count(assistant, F.lit("let me recall the user's instructions"))
    body = F.element_at(F.split(assistant, "\n\n", 2), 2)
    said = F.when((recalls > 1) & body.isNotNull(), F.concat(prefix(description), body)).otherwise(assistant)
    return F.struct(asked.alias("user"), said.alias("assistant"))


def kept(cot: Column, new_cot: Column, name: Column, length: Column | None = None, cap: int = MAX_CHARS) -> Column:
    """True unless a transform other than identity changed nothing, or the chat is too long."""
    ok = (new_cot != cot) | (name == "identity")
    return ok if length is None else ok & (length <= cap)


def all_forward(text: Column, names: list[str] | None = None) -> Column:
    """Array of ``function_name, description, new_text`` over forward transforms."""
    one = lambda n: F.struct(F.lit(n).alias("function_name"), F.lit(tr.FORWARD[n][1]).alias("description"), tr.FORWARD[n][0](text).alias("new_text"))
    return F.array(*[one(n) for n in names or tr.FORWARD])


def fan_out(rows: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Exactly ``n`` transformed texts per row, identity first, the rest in hash order; rows with fewer are dropped.

    The transforms of a row are chosen inside the row, so nothing is shuffled.
    """
    text = F.col(text_col)
    fits = F.filter(all_forward(text), lambda c: (c["new_text"] != text) | (c["function_name"] == "identity"))
    order = lambda c: F.struct((c["function_name"] != "identity").alias("k"), F.md5(F.concat_ws("|", c["function_name"], F.col(id_col).cast("string"), F.lit(str(seed)))).alias("h"), c.alias("c"))
    ranked = F.slice(F.array_sort(F.transform(fits, order)), 1, n)
    # bound, since a filter on the size would be pushed below and compute all transforms again
    whole = let(ranked, lambda r: F.when(F.size(r) == n, r))
    return (
        rows.where(text.isNotNull())
        .select(id_col, F.posexplode(whole).alias("rank", "x"))
        .select(id_col, "rank", F.col("x.c.function_name").alias("function_name"), F.col("x.c.new_text").alias("new_text"))
    )


def one_function(key: Column, names: list[str]) -> Column:
    """One function per row, chosen by the row's key."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(key.cast("long"), F.lit(len(names))) + 1).cast("int"))


def continuation(user: Column, prefill: Column, template: str = "<|user|>\n{user}\n<|assistant|>\n{prefill}") -> Column:
    """Prompt that lets a model go on from a begun answer; the template names the role marks."""
    head, rest = template.split("{user}")
    middle, tail = rest.split("{prefill}")
    return F.concat(F.lit(head), user, F.lit(middle), prefill, F.lit(tail))


PROMPTS: dict[str, str] = {
    "seed": "Here are instructions that a program can check:\n{seeds}\nWrite {n} more, each on a line that begins with '- '.",
    "eval_function": 'Write a function that checks: {instruction}\nAnswer with a ```json block {{"func": ..., "cases": [{{"input": ..., "output": ...}}]}}.',
    "back_translate": "Which instruction does this function check?\n{func}\nAnswer with a JSON list of texts.",
    "rewrite": "Rewrite the response so that it follows the instruction.\n[Instruction] {instruction}\n[Response] {response}\n[Query] {query}",
    "judge": "Rate from 0 to 10 how well the response follows the instruction and answers the query. End with 'Score: n'.\n[Instruction] {instruction}\n[Response] {response}\n[Query] {query}",
    "annotate": "For each numbered chunk give its result and whether it is correct, as a ```json list.\n{chunks}",
    "hindsight": "Which instruction would make this the best answer?\n[Question] {question}\n[Answer] {answer}",
}


def prompt(name: str, **values: Column) -> Column:
    """A prompt with columns for its placeholders."""
    out: list[Column] = []
    rest = PROMPTS[name].replace("{{", "\x03").replace("}}", "\x04")
    while "{" in rest:
        head, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        out += [F.lit(head.replace("\x03", "{").replace("\x04", "}")), values[key]]
    return F.concat(*out, F.lit(rest.replace("\x03", "{").replace("\x04", "}")))


def ranked_within(rows: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
