"""Safety and grounding: personal data, injections, output scans, citations, quantities and polarity."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- personal data ----------------------------------------------------------------------------------------------------

#: Patterns of personal data, and what an anonymised text shows of each (fixed values).
PII = {
    "PHONE_CN": (r"1[3-9]\d{9}", "mask"),
    "ID_CARD_CN": (r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", "mask"),
    "EMAIL": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "mask"),
    "IP_ADDRESS": (r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "redact"),
    "CREDIT_CARD": (r"\b(?:\d[ -]*?){13,19}\b", "mask"),
    "API_KEY": (r"(?i)(?:sk-|pk-|api[_-]?key)[a-zA-Z0-9_-]{16,}", "redact"),
}
#: Score of a match of these patterns.
PII_SCORE = 0.9
SPAN = "array<struct<type:string,start:int,end:int,score:double,value:string>>"


def luhn(c: Column) -> Column:
    """13 to 19 digits, separators aside, with a right check digit."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pii_counts(c: Column) -> dict[str, Column]:
    return {k: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)) for k, (p, _) in PII.items()}


def find_pii(df: DataFrame, text: str, least: float = 0.5) -> DataFrame:
    """df with `pii`: spans by start, the longest of those that begin together, overlaps out (the first one stays)."""
    import re

    patterns = [(k, re.compile(p)) for k, (p, _) in PII.items() if PII_SCORE >= least]

    @F.pandas_udf(SPAN)
    def scan(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = sorted(((m.start(), -m.end(), i, k, m[0]) for i, (k, p) in enumerate(patterns) for m in p.finditer(t or "")))
            spans, at = [], 0
            for a, b, _, k, v in found:
                if a >= at:
                    spans.append({"type": k, "start": a, "end": -b, "score": PII_SCORE, "value": v})
                    at = -b
            out.append(spans)
        return pd.Series(out)

    return df.withColumn("pii", scan(F.col(text)))


def anonymise(text: Column, spans: Column, how: str | None = None) -> Column:
    """Spans replaced by [TYPE], or masked but for a quarter at both ends (one character at least; at the front only where
    both would meet), as each type has it or all by `how`. Rebuilt left to right, so offsets never drift."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at"))
    redacted = [k for k, (_, shown) in PII.items() if (how or shown) == "redact"]

    def add(acc: Column, s: Column) -> Column:
        n = s["end"] - s["start"]
        seen = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
        value = F.substr(text, s["start"] + 1, n)
        tail = F.when(n > 2 * seen, F.substr(value, n - seen + 1, seen)).otherwise("")
        masked = F.concat(F.substr(value, F.lit(1), seen), F.repeat(F.lit("*"), n - seen - F.length(tail)), tail)
        hidden = F.when(s["type"].isin(redacted), F.concat(F.lit("["), s["type"], F.lit("]"))).otherwise(masked)
        return F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), hidden).alias("out"), s["end"].alias("at"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), F.length(text) - acc["at"]))))


# --- injections and output --------------------------------------------------------------------------------------------

#: Injection rules: category, pattern (any case) and risk (fixed values); 7 blocks, 9 is critical.
INJECTION = [
    ("instruction_override", r"忽略(?:所有|上述|之前|系统)?(?:指令|提示词|规则|约束)", 9.5),
    ("instruction_override", r"(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|above|prior|earlier|system)\s+(?:instructions?|prompts?|rules?|constraints?)", 9.5),
    ("new_instructions", r"(?:new|updated|revised|real)\s+(?:instructions?|system\s+prompt|directive)", 8.5),
    ("role_hijack", r"(?:你(?:现在|要)是|扮演|假装|you\s+are\s+now|act\s+as|pretend\s+to\s+be)", 8.0),
    ("exfil_request", r"(?:输出|显示|回复|打印|reveal|show|print|display)\s*(?:所有|全部)?\s*(?:系统)?(?:提示词|指令|密码|密钥|api[_-]?key|token|secret|credential)", 9.5),
    ("exfil_request", r"(?:output|print|display|reveal|show|send|transmit)\s+(?:all\s+)?(?:api[_-]?keys?|passwords?|secrets?|credentials?|tokens?)", 9.5),
    ("exfil_url", r"(?:发送|上传|post|send|upload|transmit)\s+(?:[\w\s]{0,20}\s+)?(?:到|to)\s+(https?://)", 9.0),
    ("delimiter_escape", r"[-=*]{3,}\s*(?:END|BEGIN|SYSTEM|ADMIN|ROOT)\s*[-=*]{3,}", 8.0),
    ("dan_jailbreak", r"(?:DAN|do\s+anything\s+now|developer\s+mode|jailbreak|越狱)", 7.0),
    ("base64_payload", r"(?:base64|b64)\s*(?:解码|decode|exec|eval|run|执行)", 7.5),
    ("system_prompt_query", r"(?:你的(?:系统)?(?:提示词|指令|prompt|system\s+prompt)(?:.*(?:是|是什么|有哪些))?)", 6.0),
    ("system_prompt_query_output", r"(?:输出|显示|回复|打印|reveal|show|print)\s*(?:你的)?(?:系统)?(?:提示词|指令|prompt)", 7.0),
]
#: What an answer must not hold: personal data in the order of the checks, phrases of a prompt (any case), code (fixed values).
OUTPUT_PII = [
    ("phone", r"1[3-9]\d{9}"),
    ("id_card", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"),
    ("bank_card", r"(?<!\d)\d{16,19}(?!\d)"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("api_key", r"(?:sk-[a-zA-Z0-9]{20,}|AKIA[0-9A-Z]{16}|pk-[a-zA-Z0-9]{20,})"),
]
LEAKS = ["system prompt", "system message", "你被设计为", "你的任务是", "作为AI", "作为智能助手", "你必须", "你绝对不能"]
CODE = [r"\beval\s*\(", r"\bexec\s*\(", r"\b__import__\s*\(", r"\bcompile\s*\(", r"\bos\.system\s*\(", r"\bsubprocess\.", r"\bBase64\b.{0,20}(?:decode|exec)"]


def any_case(c: Column, pattern: str) -> Column:
    return F.regexp(c, F.lit(f"(?iuU){pattern}"))


def injection_score(c: Column) -> Column:
    """The largest risk of the rules that match; 0 without a match."""
    t = F.coalesce(c, F.lit(""))
    return F.greatest(*[F.when(any_case(t, p), w).otherwise(0.0) for _, p, w in INJECTION])



def injection_level(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score > 0, "suspicious").otherwise("none")


def output_reason(c: Column) -> Column:
    """The first hit of an answer: personal data by its kind (cards need a right check digit), two phrases of a prompt, or code; NULL if clean."""
    t = F.coalesce(c, F.lit(""))
    personal = lambda k, p: F.exists(F.regexp_extract_all(t, F.lit(p), F.lit(0)), luhn) if k == "bank_card" else F.regexp(t, F.lit(p))
    first = F.coalesce(*[F.when(personal(k, p), f"pii_leak:{k}") for k, p in OUTPUT_PII])
    leaks = reduce(Column.__add__, [any_case(t, p).cast("int") for p in LEAKS])
    code = reduce(Column.__or__, [any_case(t, p) for p in CODE])
    return F.when(F.trim(t) == "", None).otherwise(F.coalesce(first, F.when(leaks >= 2, "system_prompt_leak"), F.when(code, "code_injection")))


def guardrail(risks: Column, injection: Column, block: float = 0.65, clear: float = 0.35) -> Column:
    """threat: the first category of array<struct<category, p>> from 0.65 on; uncertain: any p between, or missing; injection from 0.5 on."""
    threat = F.get(F.filter(risks, lambda r: r["p"] >= block), F.lit(0))["category"]
    unsure = F.exists(risks, lambda r: r["p"].isNull() | ((r["p"] > clear) & (r["p"] < block)))
    return F.struct(threat.alias("threat"), F.coalesce(unsure, F.lit(False)).alias("uncertain"), (F.coalesce(injection, F.lit(0.0)) >= 0.5).alias("injection"))


#: Risk of agent tools (fixed values).
TOOL_RISK = {"search": "low", "retrieve": "low", "calculator": "low", "web_search": "medium", "code_executor": "high", "file_write": "high", "shell": "critical"}


#: Words in the arguments of a high-risk tool that ask for approval (fixed values).
DESTRUCTIVE = ["DELETE", "DROP", "TRUNCATE", "ALTER", "GRANT", "REVOKE"]


def tool_risk_level(tool: Column) -> Column:
    """A tool's risk; unknown and null tools are high."""
    return reduce(lambda w, kv: w.when(tool == kv[0], kv[1]), TOOL_RISK.items(), F.when(F.lit(False), "")).otherwise("high")


def approval(tool: Column, arguments: Column, policy: Column | None = None) -> Column:
    """struct<risk, required, word>: whether a call needs a person's approval, and the first destructive word of its arguments.

    Critical tools always need it, high ones if their arguments (text; null is none) hold such a word in either case, others
    never. A policy (boolean) that says so asks for it first, and a null one counts as failed, which asks too.
    """
    risk = tool_risk_level(tool)
    text = F.upper(F.coalesce(arguments, F.lit("")))
    word = F.get(F.filter(F.array(*map(F.lit, DESTRUCTIVE)), lambda w: F.contains(text, w)), F.lit(0))
    required = (risk == "critical") | ((risk == "high") & word.isNotNull())
    required = required if policy is None else F.coalesce(policy, F.lit(True)) | required
    return F.struct(risk.alias("risk"), required.alias("required"), F.when(risk == "high", word).alias("word"))


def tool_decision(tool: Column, approved: Column) -> Column:
    risk = tool_risk_level(tool)
    return F.struct(risk.alias("risk"), F.when(risk == "critical", "deny").when((risk == "high") & ~approved, "confirm").otherwise("allow").alias("decision"))


def code_issues(c: Column) -> Column:
    """Names of imports and calls that a sandbox refuses, by parsing (nothing is run); ["syntax"] for what does not parse."""

    @F.pandas_udf("array<string>")
    def check(codes: pd.Series) -> pd.Series:
        import ast

        banned_modules = {"os", "sys", "subprocess", "socket", "shutil", "ctypes", "importlib", "pathlib"}
        banned_calls = {"eval", "exec", "compile", "open", "__import__", "input", "globals", "locals", "getattr", "setattr"}

        def issues(code: str | None) -> list[str]:
            try:
                tree = ast.parse(code or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return ["syntax"]
            found = set()
            for node in ast.walk(tree):
                if isinstance(node, ast.Import):
                    found |= {a.name.split(".")[0] for a in node.names} & banned_modules
                elif isinstance(node, ast.ImportFrom):
                    found |= {(node.module or "").split(".")[0]} & banned_modules
                elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
                    found |= {node.func.id} & banned_calls
                elif isinstance(node, ast.Attribute) and node.attr.startswith("__"):
                    found.add(node.attr)
            return sorted(found)

        return codes.map(issues)

    return check(c)


# --- grounding --------------------------------------------------------------------------------------------------------

#: Units of quantities, longer ones first, and words of the polarity rules (fixed values).
UNITS = ["万元", "千米", "公里", "个月", "分钟", "小时", "元", "天", "日", "月", "年", "晚", "次", "人", "个", "倍", "岁", "%", "％"]
QUANTITY = "(?U)(?<![A-Za-z0-9.第])(\\d+(?:\\.\\d+)?)\\s*(" + "|".join(UNITS) + ")"
CN_QUANTITY = "(?U)([一二三四五六七八九十百千两]+)\\s*(" + "|".join(u for u in UNITS if u not in "%％") + ")"
PROTECTED = r"(?U)[A-Za-z]{1,3}\d+(?:\+)?|\d+\s*类|第\s*\d+\s*条"
NUMBER = r"(?s)(?<![A-Za-z0-9.,])([0-9]+(?:\.[0-9]+)?)(?![A-Za-z0-9])(?=(.{0,3}))"
PROHIBITION, PERMIT, DENIAL = "禁止|不得|严禁|不允许|不予受理", "可以|允许|可申请|有权|准予|可享受", "不|未|无|禁止|严禁|拒绝|避免"
ASIDES = "^(另|此外|同时|另外|附带|补充)"
#: Claims that need a source, and words that deny a mention within 14 characters of it (fixed values).
CLAIM = r"(?U)\d+(?:\.\d+)?\s*(?:元|块|天|日|个月|月|年|%|％|次|小时|人|晚|公里|km|倍|万)|\d+(?:\.\d+)?\s*条|第\s*(?:\d{1,3}|[零一二三四五六七八九十]{1,3})\s*条"
NAMED = r"《([^》]{2,80})》"
CLAUSE = r"第\s*(\d{1,3}(?:\.\d{1,3})?|[零一二三四五六七八九十]{1,3})\s*条"
DENIED = ["未收录", "未找到", "未提供", "未涉及", "未包含", "未规定", "未明确", "没有", "不存在", "无法核实", "无法确认", "未能核实", "无法找到", "未见", "暂无", "不包含"]
NEAR = 14


def citations(c: Column) -> Column:
    """Distinct reference numbers in their order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))


def plain_numbers(c: Column) -> Column:
    """Full-width digits read, separators of thousands out."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "０１２３４５６７８９．", "0123456789."), r"(?<=\d)[,，](?=\d{3}(?!\d))", "")


def uncited(c: Column) -> Column:
    return plain_numbers(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[(\d{1,3})\]", " "))


def in_python(pattern: str) -> re.Pattern:
    """A Java pattern for Python: white space and digits as the flags say."""
    wide = pattern.startswith("(?U)")
    space, digits = (r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", r"\d") if wide else (r"[ \t-\r]", "[0-9]")
    return re.compile(pattern.removeprefix("(?U)").replace(r"\s", space).replace(r"\d", digits))


WIDE = str.maketrans("０１２３４５６７８９．", "0123456789.")
CITED, SEPARATORS = re.compile(r"\[[0-9]{1,3}\]"), re.compile(r"(?<=[0-9])[,，](?=[0-9]{3}(?![0-9]))")
QUANTITIES, CN_QUANTITIES, MASKED, NUMBERS = map(in_python, (QUANTITY, CN_QUANTITY, PROTECTED, NUMBER))
CN_DIGITS, CN_UNITS = {**{c: i for i, c in enumerate("一二三四五六七八九", 1)}, "两": 2}, {"十": 10, "百": 100, "千": 1000}


def cn_value(numeral: str) -> float | None:
    """As text.cn_to_number, for the characters of CN_QUANTITY."""
    total = pending = 0
    for x in numeral:
        if x in CN_UNITS:
            total, pending = total + (pending or 1) * CN_UNITS[x], 0
        else:
            pending = CN_DIGITS[x]
    return float(total + pending) or None


def without_citations(t: str | None) -> str:
    return SEPARATORS.sub("", CITED.sub(" ", t or "").translate(WIDE))


def cn_amounts(t: str) -> list[tuple[float, str]]:
    found = ((cn_value(n), u) for n, u in CN_QUANTITIES.findall(t))
    return [(v * 10_000 if u == "万元" else v, u) for v, u in found if v is not None]


def amounts(t: str | None) -> list[tuple[float, str]]:
    t = without_citations(t)
    return [(float(n) * 10_000 if u == "万元" else float(n), u) for n, u in QUANTITIES.findall(t)] + cn_amounts(t)


@lru_cache(4096)
def all_values(t: str | None) -> list[float]:
    t = without_citations(t)
    out = {v for v, _ in cn_amounts(t)}
    for n, after in NUMBERS.findall(MASKED.sub(" ", t)):
        out.add(float(n))
        if "万元" in after:
            out.add(float(n) * 10_000)
    return sorted(out)


def quantities(c: Column) -> Column:
    """array<struct<value, unit>> of the numbers with units in a text, 万元 as 元's value; Chinese numerals after the others."""

    @F.arrow_udf("array<struct<value:double,unit:string>>")
    def read(texts: pa.Array) -> pa.Array:
        rows = [[{"value": v, "unit": u} for v, u in amounts(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("value", pa.float64()), ("unit", pa.string())])))

    return read(c)


def token_values(c: Column) -> Column:
    """All distinct values of a text in ascending order, with or without units; grades, classes and clause numbers don't count."""

    @F.arrow_udf("array<double>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([all_values(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return read(c)


def missing_values(fragment: Column, texts: Column) -> Column:
    """Values of a fragment that none of its texts holds, in ascending order."""

    @F.arrow_udf("array<double>")
    def read(fragments: pa.Array, cited: pa.Array) -> pa.Array:
        rows = zip(fragments.to_pylist(), cited.to_pylist(), strict=True)
        return pa.array([[v for v in own if v not in held] for own, held in ((all_values(f), {v for t in ts or [] for v in all_values(t)}) for f, ts in rows)], pa.list_(pa.float64()))

    return read(fragment, texts)


def denied(sentence: Column, mention: Column) -> Column:
    """Whether every mention (a pattern) in a sentence has a word of denial within 14 characters on either side."""
    near = [(w, NEAR - len(w)) for w in DENIED]
    before = "(?:" + "|".join(f"{w}.{{0,{k}}}" for w, k in near) + ")"
    after = "(?:" + "|".join(f".{{0,{k}}}{w}" for w, k in near) + ")"
    either = F.concat(F.lit(f"(?s){before}"), mention, F.lit("|"), mention, F.lit(after))
    return F.regexp_count(sentence, mention) <= F.regexp_count(sentence, either)


def audit_answer(answers: DataFrame, references: DataFrame) -> DataFrame:
    """answer_id, issue, detail, distinct. answers: answer_id, answer; references: answer_id, ref, document_name, content.

    Issues: a citation without its reference, a document or clause that no reference names (unless it is denied), and a
    fragment with a quantity or clause but no citation of its own.
    """
    from quarry.functions import text as T

    matched = T.normalize_for_match
    name = F.coalesce("document_name", F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?i)\.(md|pdf|docx|txt|doc)$", "")
    labels = F.filter(F.array(matched(name), matched(stem), matched(F.regexp_replace(stem, r"^[\d_\-\s]+", ""))), lambda x: F.length(x) >= 2)
    body = F.concat_ws(" ", name, "content")
    numbers = F.transform(F.filter(F.regexp_extract_all(body, F.lit(CLAUSE), F.lit(1)), lambda x: ~F.contains(x, F.lit("."))), T.cn_to_int)
    own = references.groupBy("answer_id").agg(
        F.collect_set("ref").alias("ids"), F.flatten(F.collect_set(labels)).alias("labels"), F.collect_set(matched(body)).alias("bodies"), F.flatten(F.collect_set(numbers)).alias("numbers")
    )
    sentences = answers.select("answer_id", F.explode(F.filter(F.split(F.coalesce("answer", F.lit("")), r"(?<=[。！？!?；;\n])"), lambda x: F.trim(x) != "")).alias("s")).join(own, "answer_id", "left")
    held = lambda t: F.exists(F.coalesce("bodies", F.array().cast("array<string>")), lambda b: F.contains(b, t))

    def known_name(n: Column) -> Column:
        t = matched(n)
        return (F.length(t) < 2) | held(t) | F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.contains(x, t) | F.contains(t, x))

    def known_clause(n: Column) -> Column:
        value = T.cn_to_int(n)
        there = F.array_contains(F.coalesce("numbers", F.array().cast("array<int>")), value) | held(F.concat(F.lit("第"), value.cast("string"), F.lit("条")))
        return F.when(F.contains(n, F.lit(".")), held(matched(n))).otherwise(value.isNull() | F.coalesce(there, F.lit(False)))

    s = F.col("s")
    cited = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))
    dangling = F.transform(F.array_except(cited, F.coalesce("ids", F.array().cast("array<int>"))), lambda x: x.cast("string"))
    names = F.filter(T.found(s, NAMED), lambda n: (F.trim(n) != "") & ~known_name(F.trim(n)) & ~denied(s, F.concat(F.lit("《\\Q"), n, F.lit("\\E》"))))
    clauses = F.filter(T.found(s, CLAUSE), lambda n: ~known_clause(n) & ~denied(s, F.concat(F.lit("第\\s*\\Q"), n, F.lit("\\E\\s*条"))))
    loose = F.filter(F.transform(F.split(s, "[，,、]"), T.strip), lambda f: (f != "") & ~F.regexp(f, F.lit(r"\[\d+\]")) & F.regexp(f, F.lit(CLAIM)))
    kinds = {"dangling_reference": dangling, "unknown_document": names, "unknown_clause": clauses, "uncited_claim": loose}
    tagged = lambda k, xs: F.transform(xs, lambda x: F.struct(F.lit(k).alias("issue"), x.alias("detail")))
    issues = F.flatten(F.array(*[tagged(k, xs) for k, xs in kinds.items()]))
    return sentences.select("answer_id", F.explode(issues).alias("i")).select("answer_id", "i.issue", "i.detail").distinct()


def cited_fragments(answers: DataFrame) -> DataFrame:
    """answer_id, fragment_no, fragment, refs: comma-wise pieces of the sentences that cite, with their own references or else the sentence's.

    Pieces without a reference of their own that begin as an aside don't count.
    """
    from quarry.functions import text as T

    sentences = F.filter(F.transform(F.split(plain_numbers(F.col("answer")), "[。！？\n]+"), T.strip), lambda s: F.size(citations(s)) > 0)

    def pieces(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, "[，,、]"), T.strip), lambda f: (f != "") & ((F.size(citations(f)) > 0) | ~F.regexp(f, F.lit(ASIDES))))
        return F.transform(parts, lambda f: F.struct(f.alias("fragment"), F.array_sort(F.when(F.size(citations(f)) > 0, citations(f)).otherwise(citations(s))).alias("refs")))

    return answers.select("answer_id", F.posexplode(F.flatten(F.transform(sentences, pieces))).alias("fragment_no", "p")).select("answer_id", "fragment_no", "p.fragment", "p.refs")


def cited_texts(fragments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each fragment with `texts`, the contents that it cites (evidence: answer_id, ref, content). Answers without evidence are left out."""
    refs = fragments.join(evidence.select("answer_id").distinct(), "answer_id", "left_semi").select("*", F.explode("refs").alias("ref"))
    return refs.join(evidence, ["answer_id", "ref"], "left").groupBy("answer_id", "fragment_no", "fragment", "refs").agg(F.collect_list("content").alias("texts"))


def number_mismatches(fragments: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """answer_id, fragment_no, value, refs: values of a fragment that none of its cited texts holds; the first `most` of an answer."""
    from quarry.operators.ranking import top

    found = cited_texts(fragments, evidence).select("answer_id", "fragment_no", missing_values(F.col("fragment"), F.col("texts")).alias("missing"), "refs")
    rows = found.select("answer_id", "fragment_no", F.explode("missing").alias("value"), "refs")
    return top(rows, most, F.col("fragment_no"), F.col("value"), key=("answer_id",)).select("answer_id", "fragment_no", "value", "refs")


def polarity_flips(fragments: DataFrame, evidence: DataFrame, most: int = 4) -> DataFrame:
    """answer_id, fragment_no, refs: fragments that permit, without a word of denial, what a cited text prohibits; `most` an answer."""
    from quarry.operators.ranking import top

    flipped = F.exists("texts", lambda t: F.regexp(t, F.lit(PROHIBITION))) & F.regexp("fragment", F.lit(PERMIT)) & ~F.regexp("fragment", F.lit(DENIAL))
    return top(cited_texts(fragments, evidence).where(flipped), most, F.col("fragment_no"), key=("answer_id",)).select("answer_id", "fragment_no", "refs")


def caution_note(numbers: Column, flips: Column, most: int = 2) -> Column:
    """A closing note on what could not be confirmed, "" if there is nothing. numbers: array<struct<value, refs>>, flips: array<struct<refs>>.

    References are named without brackets, so that the note is not read as citing them.
    """
    named = lambda refs: F.coalesce(F.nullif(F.array_join(F.transform(refs, lambda r: F.concat(F.lit("证据 "), r.cast("string"))), "、"), F.lit("")), F.lit("所引证据"))
    short = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    first = F.transform(F.slice(numbers, 1, most), lambda x: F.concat(F.lit("数值 "), short(x["value"]), F.lit(" 未出现在 "), named(x["refs"]), F.lit(" 中")))
    rest = F.transform(flips, lambda x: F.concat(named(x["refs"]), F.lit(" 为禁止性规定而回答表述为允许")))
    parts = F.transform(F.slice(F.concat(first, rest), 1, most), lambda x: F.concat(F.lit("· "), x))
    return F.when(F.size(parts) > 0, F.concat(F.lit("\n\n（注：以下内容未能在所引证据中核实，请核对原文："), F.array_join(parts, "；"), F.lit("。）"))).otherwise("")


def verify_citations(fragments: DataFrame, scores: DataFrame, mismatches: DataFrame, least: float = 0.60) -> DataFrame:
    """answer_id, ref, state: supported, or escalate where a score is missing, low, or a number differs. scores: answer_id, ref, p."""
    wrong = mismatches.select("answer_id", "fragment_no").distinct().withColumn("_wrong", F.lit(True))
    judged = fragments.select("answer_id", "fragment_no", F.explode("refs").alias("ref")).join(wrong, ["answer_id", "fragment_no"], "left").join(scores, ["answer_id", "ref"], "left")
    by_ref = judged.groupBy("answer_id", "ref").agg(F.min("p").alias("p"), F.bool_or(F.coalesce("_wrong", F.lit(False))).alias("wrong"))
    return by_ref.select("answer_id", "ref", F.when(F.col("p").isNull() | (F.col("p") < least) | F.col("wrong"), "escalate").otherwise("supported").alias("state"))


def evidence_text(child: Column, parent: Column, most: int = 1200) -> Column:
    """For a judge: the child first, its parent in what room is left."""
    c = F.substring(F.coalesce(child, F.lit("")), 1, most)
    return F.when(F.length(c) >= most - 20, c).otherwise(F.concat_ws("\n", F.nullif(c, F.lit("")), F.substr(F.coalesce(parent, F.lit("")), F.lit(1), F.lit(most) - F.length(c))))
