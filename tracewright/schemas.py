"""Schemas of the records, declared; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import StructType


def schema(ddl: str) -> StructType:
    """The type of one of the texts below; needs a running session."""
    return StructType.fromDDL(ddl)


_MESSAGES = "array<struct<role:string,content:string>>"
CONVERSATION = "conversations array<struct<`from`:string,value:string>>"
PROBLEM_SOLUTION = "problem string, generated_solution string"
INSTRUCTION_RESPONSE = "instruction string, response string"
MATH_ITEM = "problem string, answer string"
SAMPLE = f"messages {_MESSAGES}, applied_functions array<string>, num_chars bigint"
TRANSFORM = "description string, new_text string"
EVAL_FUNCTION = "prompt string, instruction string, gpt_answer array<string>"
VERIFIED_FUNCTION = (
    "instruction string, eval_func array<struct<func:string,score:double>>, cases array<struct<input:string,output:boolean>>"
)
PREFERENCE = f"messages {_MESSAGES}, is_positive int"
ANNOTATED_TRACE = (
    "question string, raw_answer string, trace string, final_answer string, "
    "annotation array<struct<id:string,result:string,correct:boolean>>, chunks array<string>"
)
CHANGE_OF_THOUGHT = (
    "question string, raw_answer string, trace string, final_answer string, "
    "annotation array<struct<id:string,change_of_thought:boolean,tokens:string,description:string>>, chunks array<string>"
)
OUTPUT = (
    "instruction string, function_name string, model_response string, model_reasoning string, gt_reasoning string, gt_response string, if_score double, score double"
)
MATH_RESULT = "prompt string, prediction string, reference string, correct boolean, extracted_gt string, extracted_pred string"
HINDSIGHT = "question string, answer string, instruction string"
FEATURES = "features array<float>, label int"
