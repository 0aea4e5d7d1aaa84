"""Signals: patterns in files, with the lines that show them. Rules are rows; one generic operator runs them all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.lineage import firsts, settle
from loam.operators.repomap import framework_hints

Pack = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Rule:
    """``pattern`` makes a signal of ``type``; ``name`` is fixed, or made of the match's groups.

    ``lines``: evidence is each match's line, else line 1. ``per_file``: matches that count in a file, if limited.
    ``cap``: evidence over all files, if limited.
    """

    type: str
    pattern: str
    name: str | None = None
    groups: tuple[int, ...] = (0,)
    lines: bool = True
    per_file: int | None = None
    cap: int | None = None


#: Rules for every file. Fixed values.
BASE_RULES = [
    Rule("api_route", r"@(app|router)\.(get|post|put|delete|patch)\([\"']([^\"']+)", groups=(2, 3)),
    Rule("data_model", r"class\s+([A-Za-z_][A-Za-z0-9_]*)\(.*(Model|Base)\)", groups=(1,)),
    Rule("messaging", r"(?i)(kafka|rabbitmq|sqs|pubsub|topic|queue)", "Queue/Topic Integration", lines=False),
    Rule("scheduled_job", r"(?i)(cron|schedule|celery beat|apscheduler)", "Scheduled Job", lines=False),
    Rule("config", r"(os\.environ\[|process\.env\.)", "Environment Configuration", lines=False),
    Rule("integration", r"(?i)(stripe|salesforce|slack|twilio|snowflake|s3|bigquery)", lines=False),
]
#: Compliance rules: distinct lines, and no new file line once 40 are gathered but one a later file. Fixed values.
COMPLIANCE_RULES = [
    Rule("compliance_pii", r"(?iU)\b(email|ssn|social security|dob|phone|address|customer[_ ]?id|pii)\b", "PII Data Touchpoints", cap=40),
    Rule("compliance_pci", r"(?iU)\b(card|cvv|pan|pci|payment|iban|routing|account number)\b", "PCI/Payment Data Touchpoints", cap=40),
    Rule("compliance_log", r"(?iU)\b(log|logger|audit)\b", "Logging/Audit Touchpoints", cap=40),
    Rule("compliance_egress", r"(?iU)\b(httpx?|requests\.|fetch\(|axios|s3|kafka|pubsub|smtp)\b", "External Egress Touchpoints", cap=40),
]
#: Security rules. Fixed values.
SECURITY_RULES = [
    Rule("security_auth", r"(?iU)\b(auth|oauth|jwt|token|login|session|rbac|acl)\b", "Authentication/Authorization Flow", cap=40),
    Rule("security_secret", r"(?iU)\b(api[_-]?key|secret|password|token)\b\s*[:=]", "Secrets Handling Surface", cap=40),
    Rule("security_owasp", r"(?iU)\b(sql|xss|csrf|ssrf|deserializ|path traversal|command injection|unsafe)\b", "OWASP Touchpoints", cap=40),
]
#: Automation hints: the first four matches a file. Fixed values.
OPPORTUNITY_RULES = [
    Rule("ai_opportunity_hint", pattern, name, per_file=4)
    for name, pattern in [
        ("rule_engine_density", r"(?iU)\b(if|elif|else if|switch|case|rule[s]?)\b"),
        ("manual_review_queue", r"(?iU)\b(manual|review|approval|approve|queue|triage)\b"),
        ("batch_reconciliation", r"(?iU)\b(batch|reconcile|reconciliation|settlement|ledger)\b"),
        ("regex_classification", r"(?iU)\b(regex|re\.compile|pattern|keyword classification|keyword)\b"),
        ("hardcoded_thresholds", r"(?iU)\b(threshold|limit|max|min|cutoff|score)\b|(?:>=|<=|>|<)\s*\d+"),
        ("high_exception_flows", r"(?iU)\b(except|catch|raise|throw|retry|fallback|error)\b"),
        ("ocr_manual_data_entry", r"(?iU)\b(ocr|scan|scanned|manual entry|data entry|form extraction)\b"),
    ]
]
#: Spring annotations and the HTTP methods they stand for. Fixed values.
SPRING_ROUTES = {
    "RequestMapping": "ANY", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH",
}

_HIT = "struct<type:string,name:string,line:int,ord:int,cap:int>"


def _hits(rule: Rule) -> Column:
    """The rule's matches in ``text`` as an array of hits."""
    if rule.lines and rule.name:  # which lines, and nothing else of the matches
        lines = T.match_lines("text", rule.pattern)
        lines = F.slice(lines, F.lit(1), F.lit(rule.per_file)) if rule.per_file else lines
        fixed = lambda line, i: F.struct(F.lit(rule.type).alias("type"), F.lit(rule.name).alias("name"), line.alias("line"), (i + 1).alias("ord"), F.lit(rule.cap).cast("int").alias("cap"))
        return F.transform(lines, fixed).cast(f"array<{_HIT}>")
    found = T.matches("text", rule.pattern)
    if rule.per_file:
        found = F.slice(found, F.lit(1), F.lit(rule.per_file))
    if rule.groups == (2, 3):
        name = lambda m: F.concat(F.upper(F.regexp_extract(m["text"], rule.pattern, 2)), F.lit(" "), F.regexp_extract(m["text"], rule.pattern, 3))
    elif rule.groups == (0,):
        name = lambda m: F.initcap(m["text"])
    else:
        name = lambda m: F.regexp_extract(m["text"], rule.pattern, rule.groups[0])
    line = (lambda m: m["line"]) if rule.lines else (lambda m: F.lit(1))
    hit = lambda m: F.struct(F.lit(rule.type).alias("type"), name(m).alias("name"), line(m).alias("line"), m["ord"].alias("ord"), F.lit(rule.cap).cast("int").alias("cap"))
    if not rule.lines and rule.name:
        one = F.array(F.struct(F.lit(rule.type).alias("type"), F.lit(rule.name).alias("name"), F.lit(1).alias("line"), F.lit(1).alias("ord"), F.lit(rule.cap).cast("int").alias("cap")))
        return F.when(F.rlike("text", F.lit(rule.pattern)), one.cast(f"array<{_HIT}>")).otherwise(F.array().cast(f"array<{_HIT}>"))
    return F.transform(found, hit).cast(f"array<{_HIT}>")


def hits(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """``type, name, path, pos, line, ord, cap``: a row for each match of each rule; one scan of the files."""
    each = F.flatten(F.array(*map(_hits, rules)))
    return files.select("path", "pos", F.explode(each).alias("h")).select("h.type", "h.name", "path", "pos", "h.line", "h.ord", "h.cap")


def capped(found: DataFrame) -> DataFrame:
    """Hits under their rule's cap: a file stops at the hit that makes the count of distinct lines reach the cap.

    A later file still adds its first hit, so the count may pass the cap. Each file with hits counts at least one, so
    the cap is reached within the first ``cap`` files of a rule; only their lines are counted in one place.
    """
    free, limited = found.where("cap is null"), found.where("cap is not null")
    lines = limited.groupBy("type", "name", "path", "pos", "line", "cap").agg(F.min("ord").alias("ord"))
    inside = Window.partitionBy("type", "name", "pos").orderBy("ord")
    ranked = lines.withColumn("k", F.row_number().over(inside)).where("k <= cap")
    heads = ranked.where("k = 1").select("type", "name", "pos", "cap")
    for bits in (8, 16, 24, 31):  # the first files of 256 neighbours, then of 256 such groups, and so on
        block = Window.partitionBy("type", "name", F.shiftright("pos", bits)).orderBy("pos")
        heads = heads.withColumn("r", F.row_number().over(block)).where("r <= cap").drop("r")
    early = heads.select("type", "name", "pos", F.lit(True).alias("early"))
    marked = ranked.join(early, ["type", "name", "pos"], "left").withColumn("early", F.coalesce("early", F.lit(False)))
    order = Window.partitionBy("type", "name", "early", F.when(~F.col("early"), F.col("pos"))).orderBy("pos", "ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = marked.withColumn("before", F.coalesce(F.count("*").over(order), F.lit(0)))
    kept = seen.where((F.col("early") & (F.col("before") < F.col("cap"))) | (F.col("k") == 1))
    return free.unionByName(kept.select(*free.columns))


def evidence_rows(found: DataFrame) -> DataFrame:
    """``type, name, cite, at``: each line that shows a signal, once, a row each; ``at`` is its file's and match's order."""
    lines = found.groupBy("type", "name", "path", "line").agg(F.min(F.struct("pos", "ord")).alias("at"))
    return lines.select("type", "name", T.cite("path", "line", "line").alias("cite"), "at")


def score_rows(found: DataFrame, prefix: str) -> DataFrame:
    """``type, score`` of a lens from hits: counted without gathering citations."""
    return evidence_rows(found).where(F.startswith("type", F.lit(prefix))).groupBy("type").agg(F.count("*").cast("double").alias("score"))


def collect(found: DataFrame) -> DataFrame:
    """Signals ``type, name, evidence``: hits by type and name, their citations in file and match order, repeats dropped.

    For pages and prompts, which take whole signals. A signal of very many citations is better read as
    :func:`evidence_rows`.
    """
    lines = found.groupBy("type", "name", "path", "line").agg(F.min(F.struct("pos", "ord")).alias("at"))
    evidence = F.array_sort(F.collect_list(F.struct("at", T.cite("path", "line", "line").alias("cite"))))
    return lines.groupBy("type", "name").agg(F.transform(evidence, lambda e: e["cite"]).alias("evidence"))


def collect_first(found: DataFrame, most: int) -> DataFrame:
    """``type, name, n, evidence``: like :func:`collect`, but ``n`` counts a signal's citations and ``evidence`` has the first ``most``.

    Citations are counted and cut as rows, so a signal of any number of them is never one value.
    """
    rows = settle(evidence_rows(found))
    counts = rows.groupBy("type", "name").agg(F.count("*").alias("n"))
    kept = firsts(rows, ["type", "name"], ["at", "cite"], most).groupBy("type", "name").agg(F.array_sort(F.collect_list(F.struct("at", "cite"))).alias("e"))
    return counts.join(kept, ["type", "name"]).select("type", "name", "n", F.transform("e", lambda e: e["cite"]).alias("evidence"))


def spring_hits(files: DataFrame) -> DataFrame:
    """Routes, entities, scheduled methods and Kafka listeners of Spring files."""
    own = files.where((F.col("lang") == "java") & F.rlike("text", F.lit("(?i:spring)|@RestController|@RequestMapping")))
    route = r"(?s)@(RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*(?:\((.*?)\))?"
    methods = F.create_map(*[F.lit(x) for pair in SPRING_ROUTES.items() for x in pair])

    def quoted(args: Column) -> Column:
        return F.nullif(F.regexp_extract(args, r"[\"']([^\"']+)[\"']", 1), F.lit(""))

    def path_of(args: Column) -> Column:
        named = F.nullif(F.regexp_extract(args, r"(?:value|path)\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
        return F.coalesce(F.nullif(F.trim(F.coalesce(named, quoted(args))), F.lit("")), F.lit("/"))

    hit = lambda kind, name, m: F.struct(F.lit(kind).alias("type"), name.alias("name"), m["line"].alias("line"), m["ord"].alias("ord"), F.lit(None).cast("int").alias("cap"))
    routes = F.transform(
        T.matches("text", route), lambda m: hit("api_route", F.concat(methods[F.regexp_extract(m["text"], route, 1)], F.lit(" "), path_of(F.regexp_extract(m["text"], route, 2))), m)
    )
    entity = r"(?s)@Entity\b(?=(?:.*?class\s+([A-Za-z_][A-Za-z0-9_]*))?)"  # looks ahead only: the next entity is found too
    entities = F.transform(T.matches("text", entity, 1), lambda m: hit("data_model", F.coalesce(F.nullif(m["text"], F.lit("")), F.lit("Entity")), m))
    jobs = F.transform(T.matches("text", r"@Scheduled\s*\("), lambda m: hit("scheduled_job", F.lit("Spring Scheduled Job"), m))
    topic = lambda m: F.concat(F.lit("Kafka "), F.coalesce(F.trim(quoted(m["text"])), F.lit("Kafka Listener")))
    kafka = F.transform(T.matches("text", r"(?s)@KafkaListener\s*\((.*?)\)", 1), lambda m: hit("messaging", topic(m), m))
    each = F.flatten(F.array(*[x.cast(f"array<{_HIT}>") for x in (routes, entities, jobs, kafka)]))
    return own.select("path", "pos", F.explode(each).alias("h")).select("h.type", "h.name", "path", "pos", "h.line", "h.ord", "h.cap")


#: Detectors by framework; each takes files and symbols and returns hits. Flask, Express and FastAPI add none of their own.
PACKS: dict[str, Pack] = {"spring": lambda files, symbols: spring_hits(files)}
PACK_HINTS = {"springframework": "spring", "@restcontroller": "spring", "@requestmapping": "spring", "fastapi": "fastapi", "flask": "flask", "express": "express"}


def detect_frameworks(files: DataFrame) -> DataFrame:
    """``label`` of the frameworks whose packs apply, by keywords in the first 4,000 characters."""
    return framework_hints(files, PACK_HINTS, 4000).distinct()


def detect_hits(files: DataFrame, symbols: DataFrame, rules: list[Rule] = BASE_RULES, packs: dict[str, Pack] = PACKS) -> DataFrame:
    """All hits of the rules and of the packs whose frameworks are present."""
    found = capped(hits(files, rules))
    present = {r[0] for r in detect_frameworks(files).collect()}  # at most one row a known framework
    for framework, pack in packs.items():
        if framework in present:
            found = found.unionByName(pack(files, symbols))
    return found


def detect_signals(files: DataFrame, symbols: DataFrame, rules: list[Rule] = BASE_RULES, packs: dict[str, Pack] = PACKS) -> DataFrame:
    """All signals of the rules and of the packs whose frameworks are present, one row a type and name."""
    return collect(detect_hits(files, symbols, rules, packs))


def evidence_paths(signals: DataFrame) -> DataFrame:
    """``type, name, path`` of the files that show each signal."""
    rows = signals.select("type", "name", F.explode("evidence").alias("cite"))
    return rows.select("type", "name", T.cite_path("cite").alias("path")).distinct()


def lens_scores(signals: DataFrame, prefix: str) -> DataFrame:
    """``type, score``: the number of citations of each signal of a lens."""
    return signals.where(F.startswith("type", F.lit(prefix))).select("type", F.size("evidence").cast("double").alias("score"))


def onboarding_scores(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """``routes, integrations, edges``: how much there is to learn."""
    counts = signals.agg(F.count_if(F.col("type") == "api_route").alias("routes"), F.count_if(F.col("type") == "integration").alias("integrations"))
    return counts.withColumn("edges", edges.agg(F.count("*")).scalar())


#: Opportunities in order of priority, and those that weigh more. Fixed values.
PRIORITIES = [
    "manual_review_queue", "rule_engine_density", "batch_reconciliation", "regex_classification", "hardcoded_thresholds",
    "high_exception_flows", "ocr_manual_data_entry",
]
HEAVY = ["manual_review_queue", "rule_engine_density", "batch_reconciliation"]


def opportunity_register(signals: DataFrame, n_edges: int, most: int = 8, least: int = 3, count: Column | None = None) -> DataFrame:
    """``rank, name, score, evidence``: hints by score, priority order among equals, filled up to ``least``.

    A score is twice the citations, times 1.25 for the heavy ones, plus up to 1.5 for a connected graph. Missing
    priorities fill up at 0.5, each citing one of the other signals' evidence, if there is any. ``count`` is the number
    of a signal's citations where ``evidence`` holds only its first ones (:func:`collect_first`).
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PRIORITIES) for x in (k, i)])
    weight = F.when(F.col("name").isin(HEAVY), 1.25).otherwise(1.0)
    score = F.round((F.size("evidence") if count is None else count) * 2.0 * weight + min(1.5, n_edges / 250.0), 2)
    hints = signals.where((F.col("type") == "ai_opportunity_hint") & F.col("name").isin(PRIORITIES))
    ranked = hints.select("name", score.alias("score"), "evidence", order[F.col("name")].alias("place"))
    every = signals.select("type", "name", F.posexplode("evidence").alias("k", "cite")).where("cite <> ''")
    spare = every.groupBy("cite").agg(F.min(F.struct("type", "name", "k")).alias("at")).orderBy("at").limit(len(PRIORITIES))  # no place lies beyond
    first = F.array_sort(F.collect_list(F.struct("at", "cite")))
    have = ranked.agg(F.collect_list("name").alias("have"), F.count("*").alias("n"))
    pool = spare.agg(F.transform(first, lambda x: x["cite"]).alias("pool"))
    missing = F.filter(F.array(*map(F.lit, PRIORITIES)), lambda k: ~F.array_contains(F.col("have"), k))
    fill = have.withColumn("pool", pool.scalar()).where(F.size("pool") > 0).select(F.explode(F.slice(missing, F.lit(1), F.greatest(F.lit(0), least - F.col("n")).cast("int"))).alias("name"), "pool")
    place = order[F.col("name")]
    filled = fill.select("name", F.lit(0.5).alias("score"), F.array(F.get("pool", place % F.size("pool"))).alias("evidence"), (place + 100).alias("place"))
    window = Window.orderBy(F.desc("score"), "place")
    return ranked.unionByName(filled).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most).select("rank", "name", "score", "evidence")
