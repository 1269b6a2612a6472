"""Schemas of the pipeline's tables, as Spark DDL."""

ANSWERS = "qid string, question string, answers array<string>, story_id string, turn_id int"
NLI_CACHE = "question string, text1 string, text2 string, label tinyint, confidence double"
GOLD_TEXT = "qid string, refs array<string>"
GOLD_NUMBER = "qid string, gold double"
SUBSET = (
    "dataset string, model string, total_questions bigint, total_wrong bigint, total_bad_rouge bigint, `uq_threshold (bottom 20.0%)` double, "
    "`rouge_l_threshold (bottom 25%)` double, wrong_and_low_uq_count bigint, bad_rouge_and_low_uq_count bigint, oc_ratio double, qids array<string>"
)
TRIVIA = "QuestionId string, Question string, Answer struct<NormalizedAliases:array<string>,HumanAnswers:array<string>>"
COQA = "id string, story string, questions array<struct<turn_id:int,input_text:string>>, answers array<struct<turn_id:int,input_text:string,span_text:string>>"
SQUAD = "paragraphs array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>"
BIOASQ = "id string, body string, ideal_answer array<string>, exact_answer variant"
SVAMP = "ID string, Body string, Question string, Answer double"
NATURAL_QUESTIONS = (
    "id string, question struct<text:string>, document struct<tokens:struct<token:array<string>,is_html:array<boolean>>>, "
    "annotations struct<id:array<string>,long_answer:array<struct<start_token:int,end_token:int>>,short_answers:array<struct<text:array<string>>>>, "
    "long_answer_candidates struct<start_token:array<int>,end_token:array<int>,top_level:array<boolean>>"
)
