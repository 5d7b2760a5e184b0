"""Reports as JSON and SARIF.

``result_rows``, ``sarif_rows`` and ``window_rows`` are frames with one JSON
text per row and scale with the data; the document writers gather them, for the
flagged packages of one project, on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import texts
from ..operators import exposure, routes, scoring, views
from ..operators.correlate import Campaigns, kind_rank
from ..operators.ranks import heads
from ..plans.scan import History, Report

TOOL = "riskloom"


def _result() -> Column:
    findings = F.transform("findings", lambda f: F.struct(f["rule_id"].alias("rule"), f["title"].alias("title"), f["category"].alias("category"), f["weight"].alias("weight"), f["evidence"].alias("evidence")))
    score = F.struct("base", F.bround("multiplier", 2).alias("multiplier"), "categories", F.col("parts").alias("per_category"))
    return F.struct("ecosystem", "name", "version", "origin", "direct", "score", "severity", "certain", score.alias("scoring"), findings.alias("findings"))


def result_rows(verdicts: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``(pkg_id, score, name, json)`` of flagged verdicts, with what changed if asked."""
    flagged = verdicts.where("score > 0")
    if changes is None:
        return flagged.select("pkg_id", "score", "name", F.to_json(_result(), {"ignoreNullFields": "false"}).alias("json"))
    marked = flagged.join(changes.select(F.col("head_id").alias("pkg_id"), "change", F.col("was").alias("previous")), "pkg_id", "left")
    whole = F.struct(_result().alias("r"), "change", "previous")
    return marked.select("pkg_id", "score", "name", F.to_json(F.struct("ecosystem", F.col("name"), "version", "origin", "direct", "score", "severity", "certain", whole["r"]["scoring"].alias("scoring"), whole["r"]["findings"].alias("findings"), "change", "previous"), {"ignoreNullFields": "false"}).alias("json"))


def sarif_rows(verdicts: DataFrame) -> DataFrame:
    """One SARIF result per finding: ``rule_id, level, message, uri, score, severity``."""
    level = F.create_map(*[F.lit(x) for kv in fixed.SARIF_LEVELS.items() for x in kv])
    rows = verdicts.where("score > 0").select("name", "version", "spec", "origin", "score", "severity", F.explode("findings").alias("f"))
    at = F.coalesce(F.when(F.col("version") != "", F.col("version")), F.col("spec"), F.lit("None"))
    message = F.concat("name", F.lit("@"), at, F.lit(": "), F.col("f.title"), F.lit(" ("), F.array_join(F.slice("f.evidence", 1, 3), "; "), F.lit(")"))
    uri = F.when(F.col("origin") != "", F.col("origin")).otherwise(".")
    return rows.select(F.col("f.rule_id").alias("rule_id"), level[F.col("severity")].alias("level"), message.alias("message"), uri.alias("uri"), "score", "severity")


def window_rows(windows: DataFrame) -> DataFrame:
    """``(ecosystem, name, version, entered, json)`` of exposure windows."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    entered = F.struct(F.col("entered_sha").alias("sha"), iso("entered").alias("date"), F.col("entered_subject").alias("subject"), F.col("bounded").alias("exact"))
    left = F.when(F.col("left_sha").isNotNull(), F.struct(F.col("left_sha").alias("sha"), iso("left_at").alias("date"), F.col("left_subject").alias("subject")))
    none = F.array().cast("array<string>")
    row = F.struct(
        "ecosystem", "name", "version", entered.alias("entered"), left.alias("left"), F.bround("days", 2).alias("days"), "commits", "tags",
        F.col("open").alias("still_present"), F.coalesce(F.transform("malware", lambda m: m["id"]), none).alias("malware"), F.coalesce("advisories", none).alias("advisories"),
    )
    return windows.select("ecosystem", "name", "version", "entered", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def campaign_rows(campaigns: Campaigns) -> DataFrame:
    """``(number, label, json)`` of live campaigns, whole: a text holds all members of its campaign."""
    inside = campaigns.link_members.groupBy("label", "link").agg(F.sort_array(F.collect_list("pkg_key")).alias("members"))
    order = F.struct(kind_rank().alias("rank"), "display", "key", "link", F.struct("kind", F.col("key").alias("value"), "detail", "members").alias("shown"))
    links = campaigns.links.join(inside, ["label", "link"]).groupBy("label").agg(F.sort_array(F.collect_list(order)).alias("links"))
    members = campaigns.members.groupBy("label").agg(F.sort_array(F.collect_list("pkg_key")).alias("members"))
    rows = campaigns.heads.join(members, "label").join(links, "label")
    burst = F.when(F.col("burst") != "", F.col("burst"))
    return rows.select("number", "label", F.to_json(F.struct(F.col("label").alias("id"), "members", F.col("links.shown").alias("links"), burst.alias("burst")), {"ignoreNullFields": "false"}).alias("json"))


def _headline(report: Report) -> str | None:
    row = views.headline_rule(report.findings, report.packages).first()
    if row is not None:
        return f"{row['n']} package{'' if row['n'] == 1 else 's'}: {fixed.RULE_BY_ID[row['rule_id']].title}"
    n = report.verdicts.where("score > 0").count()
    return f"{n} package{'' if n == 1 else 's'} to look at before the next install" if n else None


def report_json(report: Report) -> str:
    """A whole report as one JSON document."""
    rows = result_rows(report.verdicts, report.changes).orderBy(F.desc("score"), "name").collect()
    counts = {r["severity"]: r["n"] for r in views.severity_counts(report.verdicts).collect()}
    doc = {
        "tool": TOOL,
        "online": report.online,
        "headline": _headline(report),
        "malware": [r["c"] for r in report.verdicts.where("certain").orderBy("name").select(F.concat_ws("@", "name", "version").alias("c")).collect()],
        "summary": {"scanned": report.packages.count(), "suppressed": report.suppressed.count(), **{s: counts[s] for s in reversed(fixed.SEVERITY_ORDER[1:])}},
        "campaigns": [] if report.campaigns is None else [json.loads(r["json"]) for r in campaign_rows(report.campaigns).orderBy("number").collect()],
        "warnings": report.warnings,
        "results": [json.loads(r["json"]) for r in rows],
    }
    if report.changes is not None:
        n = {r["change"]: r["n"] for r in report.changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        doc["mode"] = "diff"
        doc["summary"] |= {"changed": n.get("added", 0) + n.get("updated", 0), "removed": n.get("removed", 0), "unchanged": n.get("unchanged", 0)}
        doc["removed"] = [r.asDict() for r in report.changes.where("change = 'removed'").select("ecosystem", "name").orderBy("ecosystem", "name").collect()]
    return json.dumps(doc, indent=2, ensure_ascii=False)


def report_sarif(report: Report) -> str:
    """A whole report as SARIF 2.1.0."""
    rows = sarif_rows(report.verdicts).orderBy(F.desc("score"), "uri", "message").collect()
    used = sorted({r["rule_id"] for r in rows})
    rules = [
        {"id": i, "name": fixed.RULE_BY_ID[i].title, "shortDescription": {"text": fixed.RULE_BY_ID[i].title}, "properties": {"category": fixed.RULE_BY_ID[i].category, "weight": fixed.RULE_BY_ID[i].weight}}
        for i in used
        if i in fixed.RULE_BY_ID
    ]
    results = [
        {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}}}], "properties": {"score": r["score"], "severity": r["severity"]}}
        for r in rows
    ]
    doc = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": TOOL, "rules": rules}}, "results": results}]}
    return json.dumps(doc, indent=2, ensure_ascii=False)


def history_json(history: History) -> str:
    """A history run as one JSON document."""
    span = history.commits.agg(F.count("*").alias("n"), F.min("when").alias("a"), F.max("when").alias("b")).first()
    counted = history.summary.first()
    doc = {
        "tool": TOOL,
        "mode": "history",
        "range": {"commits": span["n"], "truncated": history.truncated, "from": span["a"] and span["a"].isoformat(), "to": span["b"] and span["b"].isoformat()},
        "summary": counted.asDict(),
        "warnings": history.warnings,
        "windows": [json.loads(r["json"]) for r in window_rows(history.reported).orderBy("entered", "name", "version").collect()],
    }
    return json.dumps(doc, indent=2, ensure_ascii=False)


def history_text(history: History, package: str = "", online: bool = False, most: int = 100) -> str:
    """A history run for a terminal: what was exposed, a line per reported window with what to do, and what was read."""
    counted = history.summary.first()
    span = history.commits.agg(F.count("*").alias("n"), F.min("when").alias("a"), F.max("when").alias("b")).first()
    shown = exposure.report_order(history.reported.withColumns({"lasted": texts.lasted(F.col("days")), "remedy": exposure.remedy()})).limit(most).collect()
    out = []
    if package:
        n = history.reported.select("name", "version").distinct().count()
        spans = history.reported.count()
        out.append(f"{n} version{'' if n == 1 else 's'} of {package} pinned here, in {spans} span{'' if spans == 1 else 's'}" if n else f"nothing like {package} was pinned here")
    elif counted["exposed"]:
        worst = exposure.longest_exposure(history.reported).withColumn("lasted", texts.lasted(F.col("days"))).first()
        until = "and still is" if worst["open"] else f"until {worst['left_at']:%Y-%m-%d}"
        out.append(f"EXPOSED: {counted['exposed']} version{'' if counted['exposed'] == 1 else 's'} on a list of malware; {worst['name']}@{worst['version']} was pinned for {worst['lasted']}, {until}")
    elif counted["with_advisories"]:
        out.append(f"{counted['with_advisories']} version{'' if counted['with_advisories'] == 1 else 's'} with an advisory")
    elif online:
        out.append(f"never exposed: none of {counted['versions']} versions in {span['n']} commits is on a list of malware or has an advisory")
    else:
        out.append(f"read, not checked: {counted['versions']} versions in {span['n']} commits; --online asks for each")
    for r in shown:
        entered = f"{r['entered']:%Y-%m-%d}" if r["bounded"] else f"by {r['entered']:%Y-%m-%d}"
        left = "now" if r["open"] else f"{r['left_at']:%Y-%m-%d}"
        out.append(f"{r['severity']:<8}  {r['ecosystem']}:{r['name']}@{r['version']}  {entered} to {left}  ({r['lasted']})")
        said = [f"{m['id']}: {m['summary']}" for m in r["malware"] or []] + ([", ".join(r["advisories"][:4])] if r["advisories"] else []) + ([f"in {', '.join(r['tags'][:4])}"] if r["tags"] else [])
        out += [f"            {x}" for x in said]
        if r["remedy"]:
            out.append(f"            {r['remedy']}")
    ever = "in the commits read" if history.truncated or history.warnings else "ever pinned"
    out.append(f"{span['n']} commits, {counted['versions']} versions {ever}" + (f", {span['a']:%Y-%m-%d} to {span['b']:%Y-%m-%d}" if span["n"] else ""))
    if history.truncated:
        out.append(f"! only the newest {span['n']} commits were read; --limit reads more")
    return "\n".join([*out, *[f"! {w}" for w in history.warnings]])


def _many(n: int, noun: str) -> str:
    return f"{n:,} {noun}" + ("" if n == 1 else "s")


def _some(names: list[str], total: int) -> str:
    """Names, and how many more there are."""
    return ", ".join(names) + (f", and {total - len(names):,} more" if total > len(names) else "")


#: What members of a campaign have in common, the strongest first, and what to think of it.
_SHARED = {"payload": "the code they run on install", "endpoint": "a host they reach on install", "publisher": "an account that is new to all of them"}
_BEHAVIOUR = "These are one finding in several places: remove them together."
_ACCOUNT = "A shared account is a question, not a proof: find out whether it belongs to these packages before the next install."


def campaign_notes(report: Report, most: int = 5, members: int = 12, links: int = 6) -> tuple[list[dict], int]:
    """The first campaigns, each with its first members and links and with how many it has of both, and how many campaigns there are.

    Of any campaign, a bounded number of rows reaches the driver.
    """
    if report.campaigns is None:
        return [], 0
    c = report.campaigns
    total = c.heads.count()
    first = c.heads.orderBy("number").limit(most).join(views.campaign_tone(c, report.verdicts).select("label", "tone"), "label", "left")
    kinds = c.links.groupBy("label").agg(F.count("*").alias("n_links"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = {r["label"]: r.asDict() | {"members": [], "links": []} for r in first.join(kinds, "label").orderBy("number").collect()}
    shown = F.col("label").isin(*rows)
    scored = c.members.where(shown).join(report.verdicts.groupBy("pkg_key").agg(F.max("score").alias("score")), "pkg_key", "left")
    for r in heads(scored, ["label"], [F.desc("score"), F.col("pkg_key")], members).orderBy("turn").collect():
        rows[r["label"]]["members"].append(r["pkg_key"])
    ordered = c.links.where(shown).withColumn("rank", kind_rank())
    for r in heads(ordered, ["label"], [F.col("rank"), F.col("display"), F.col("key")], links).orderBy("turn").collect():
        rows[r["label"]]["links"].append(r.asDict())
    return list(rows.values()), total


def _campaign_lines(report: Report, most: int = 5) -> list[str]:
    """The first campaigns: a title, the members, a line for each link, and what to do."""
    notes, total = campaign_notes(report, most)
    out = []
    for r in notes:
        shared = " and ".join(text for kind, text in _SHARED.items() if kind in r["kinds"])
        out.append(f"{r['label']}: {_many(r['n'], 'package')} that share {shared} ({r['tone']} at worst){', ' + r['burst'] if r['burst'] else ''}: {_some(r['members'], r['n'])}")
        out += [f"  {x['kind']}: {x['display']}: {x['detail']}" for x in r["links"]]
        if r["n_links"] > len(r["links"]):
            out.append(f"  and {r['n_links'] - len(r['links']):,} more links")
        out.append("  " + (_ACCOUNT if r["kinds"] == ["publisher"] else _BEHAVIOUR))
    return out + ([f"and {_many(total - len(notes), 'more campaign')}"] if total > len(notes) else [])


def _change_line(report: Report) -> str | None:
    if report.changes is None:
        return None
    n = {r["change"]: r["n"] for r in report.changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    return ", ".join(f"{n.get(k, 0)} {k}" for k in ("added", "updated", "removed", "unchanged"))


def registry_page(ecosystem: str, name: str, version: str | None) -> str | None:
    """Where a registry shows a release."""
    if ecosystem == "npm":
        return f"https://www.npmjs.com/package/{name}" + (f"/v/{version}" if version else "")
    return f"https://pypi.org/project/{name}/" + (f"{version}/" if version else "") if ecosystem == "pypi" else None


def _safe(text: str) -> str:
    """A text that stays inside a code span and a table's cell."""
    return text.replace("`", "'").replace("|", "\\|").replace("\n", " ")


def _linked(row) -> str:
    name = row["origin"] if row["kind"] == "manifest" else row["name"] + (f"@{row['version']}" if row["version"] else "")
    page = None if row["kind"] == "manifest" else registry_page(row["ecosystem"], row["name"], row["version"])
    return f"[`{_safe(name)}`]({page})" if page else f"`{_safe(name)}`"


def _callout(report: Report, most: int = 20) -> list[str]:
    """The panel on top: malware by name, else the headline at its level, else that nothing matched."""
    bad = report.verdicts.where("certain")
    names = [r["c"] for r in bad.select(F.concat_ws("@", "name", F.when(F.col("version") != "", F.col("version"))).alias("c"), "pkg_id").orderBy("c", "pkg_id").limit(most).collect()]
    if names:
        total = bad.count()
        listed = _some([f"`{_safe(n)}`" for n in names], total)
        return ["> [!CAUTION]", f"> On a public list of malware: {listed}. Remove {'it' if total == 1 else 'them'} and replace every credential that an install could read."]
    line = _headline(report)
    if line is None:
        return ["> [!NOTE]", "> Nothing flagged: no rule matched, which does not prove that nothing is wrong."]
    high = not report.verdicts.where("severity IN ('critical', 'high')").isEmpty()
    return [f"> [!{'WARNING' if high else 'NOTE'}]", f"> {line}"]


_MARKS = {"added": "+", "updated": "~"}


def report_markdown(report: Report, most: int = 20) -> str:
    """A report for a pull request: what is worst, campaigns, a table of the first ``most`` with links to their registry, and their evidence."""
    dots = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "⚪"}
    flagged = report.verdicts.where("score > 0")
    total = flagged.count()
    if report.changes is not None:
        flagged = flagged.join(report.changes.select(F.col("head_id").alias("pkg_id"), "change"), "pkg_id", "left")
    rows = scoring.ordered(flagged).limit(most).collect()
    out = [f"<!-- {TOOL} -->", f"## {TOOL}", "", *_callout(report), ""]
    if changed := _change_line(report):
        out += [f"{changed}.", ""]
    if alike := _campaign_lines(report):
        out += ["### Campaigns", "", *[f"{'  ' if x.startswith('  ') else ''}- {_safe(x.strip())}" for x in alike], ""]
    if rows:
        marked = report.changes is not None
        out += ["| | | Package | Score | Why |", "|:--:|:--:|---|--:|---|"] if marked else ["| | Package | Score | Why |", "|:--:|---|--:|---|"]
        for r in rows:
            first, more = r["findings"][0]["title"], len(r["findings"]) - 1
            mark = f" `{_MARKS[r['change']]}` |" if marked and r["change"] in _MARKS else " |" if marked else ""
            out.append(f"| {dots[r['severity']]} |{mark} {_linked(r)} | {'**malware**' if r['certain'] else r['score']} | {first}{f', and {more} more' if more else ''} |")
        out.append("")
        if total > most:
            out += [f"{total - most:,} more, worst first.", ""]
        out += ["<details>", "<summary>Evidence</summary>", ""]
        for r in rows:
            out += [f"**{_safe(r['name'])}** {r['ecosystem']} `{_safe(r['origin'])}`", ""]
            for f in r["findings"]:
                out.append(f"- `{f['rule_id']}` {f['title']}")
                out += [f"  - `{_safe(e)}`" for e in f["evidence"][:4]]
                out += [f"  - {len(f['evidence']) - 4} more"] if len(f["evidence"]) > 4 else []
            out += ["", f"*fix:* {r['findings'][0]['fix']}", ""]
        out += ["</details>", ""]
    return "\n".join([*out, *[f"> {w}" for w in report.warnings]])


#: Names of a crowd that a report lists, unless it is why the run fails.
CROWD_NAMES = 24


def _crowd_lines(report: Report, fail_on: str, most: int = 40) -> list[str]:
    """A line for each crowd with its first names; a crowd at or above ``fail_on`` names every package, read row by row."""
    found = views.crowds(report.verdicts).orderBy(F.desc("score"), "first_name").limit(most).collect()
    listed: dict[tuple, list[str]] = {}
    for r in views.crowd_names(report.verdicts, CROWD_NAMES).orderBy("rules", "turn").collect() if found else ():
        listed.setdefault(tuple(r["rules"]), []).append(r["name"])
    out = []
    for r in found:
        severity = next(s for floor, s in fixed.SEVERITIES if r["score"] >= floor)
        names = listed[tuple(r["rules"])]
        if views.at_or_above(severity, fail_on) and r["n"] > len(names):
            names = [x["name"] for x in views.crowd_members(report.verdicts, r["rules"]).toLocalIterator()]
        title = fixed.RULE_BY_ID[r["rules"][0]].title + (f", and {len(r['rules']) - 1} more" if len(r["rules"]) > 1 else "")
        out.append(f"{r['score']:>3}  {severity:<8}  {_many(r['n'], 'package')}: {', '.join(r['rules'])}  {title}")
        out.append(f"     {_some(sorted(names), r['n'])}")
        out.append(f"     fix: {fixed.RULE_BY_ID[r['rules'][0]].fix}")
    return out


def _exit_line(report: Report, fail_on: str) -> list[str]:
    """Which packages made the run fail."""
    if fail_on not in fixed.SEVERITY_ORDER:
        return []
    r = views.gate(report.verdicts, fail_on).first()
    if not r["n"]:
        return []
    names = r["blamed"].split(", ")
    return [f"exit 1: {_many(r['n'], 'package')} at {fail_on} or above: {_some(names, r['n'])}"]


def _ways(report: Report, rows: list) -> dict[tuple[str, str], str]:
    """The first route to each package of ``rows`` that was not asked for directly."""
    names = sorted({(r["ecosystem"], r["name"]) for r in rows if r["kind"] == "package" and not r["direct"]})
    if report.edges is None or not names:
        return {}
    targets = report.edges.sparkSession.createDataFrame(names, "ecosystem string, name string")
    found = routes.routes_to(report.edges, routes.roots_of(report.edges, report.packages), targets, limit=1).collect()
    return {(r["ecosystem"], r["target"]): " > ".join(r["route"]) for r in found if len(r["route"]) > 1}


def verdict_lines(row, way: str | None = None) -> list[str]:
    """A verdict with its arithmetic (``how``), its findings and their evidence, how it came in and what to do."""
    name = row["origin"] if row["kind"] == "manifest" else f"{row['ecosystem']}:{row['name']}{'@' + row['version'] if row['version'] else ''}"
    out = [f"{row['score']:>3}  {row['severity']:<8}  {name}  ({row['origin']})"]
    if row["findings"]:
        out.append(f"     {row['how']}")
    for f in row["findings"]:
        out.append(f"     {f['rule_id']}  {f['title']}")
        out += [f"       {e}" for e in f["evidence"][:4]]
        out += [f"       and {len(f['evidence']) - 4} more"] if len(f["evidence"]) > 4 else []
    if way:
        out.append(f"     via {way}")
    if row["findings"]:
        out.append(f"     fix: {row['findings'][0]['fix']}")
    return out


def report_text(report: Report, fail_on: str = "high", show_all: bool = False, most: int = 500) -> str:
    """A report for a terminal: crowds of equal findings folded, then verdicts, then counts and why the run fails.

    At most ``most`` verdicts are told one by one, the worst first, and the rest
    are counted.  ``show_all`` also tells of packages without findings.
    """
    single = report.verdicts.where("score = 0").unionByName(views.told_singly(report.verdicts)) if show_all else views.told_singly(report.verdicts)
    rows = scoring.ordered(single.withColumn("how", scoring.arithmetic())).limit(most + 1).collect()
    ways = _ways(report, rows[:most])
    out = _campaign_lines(report)
    for r in rows[:most]:
        out += verdict_lines(r, ways.get((r["ecosystem"], r["name"])))
    if len(rows) > most:
        out.append(f"and {single.count() - most:,} more verdicts")
    out += _crowd_lines(report, fail_on)
    if changed := _change_line(report):
        out.append(changed)
    counts = views.severity_counts(report.verdicts).collect()
    out.append(", ".join(f"{r['n']} {r['severity']}" for r in counts if r["n"]) or "nothing matched")
    return "\n".join([*out, *_exit_line(report, fail_on), *[f"! {w}" for w in report.warnings]])
