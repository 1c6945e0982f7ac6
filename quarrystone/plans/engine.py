"""The engine: ingest, standardise, check, match, build golden vendors, triage, watch; and what stewards do."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Sequence
from dataclasses import asdict
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone import config
from quarrystone.config import LAKEHOUSE, Profile
from quarrystone.operators import components, evaluate, golden, learning, library, mapping_learner, matching, patterns, profiling, rules, sentinel, spend, standardize
from quarrystone.operators.rules import ANOMALY, RULES, Rule
from quarrystone.plans.llm_client import Budgeted, ask_cause, ask_mappings, ask_pairs, ask_recommendation, ask_rule
from quarrystone.sources.files import decisions, export, json_safe, report
from quarrystone.sources.store import Store, read_csv, union_all

PATTERN_DECISIONS = "pattern_id string, item_id string, kind string, decision string, affected_records long, reviewer string, note string, library_version long, decided_at timestamp"
OPINIONS = "fingerprint string, decision string, confidence double, explanation string, model string, created_at timestamp"
#: Fields of the stored inboxes and the values they may have.
DECISIONS = ("approve", "reject")
INBOXES = {
    "pattern": {"pattern_id": None, "decision": DECISIONS},
    "pair": {"left_key": None, "right_key": None, "decision": ("match", "no_match", "unsure")},
    "unmerge": {"record_key": None},
    "rule": {"sentence": None},
}
MODELS = "name string, version long, features string, weights string, metrics string, snapshots string, trained_at timestamp"
PROCESSED = "inbox string, id string, status string, at timestamp"
EVENTS = "run_id string, stage string, action string, detail string, records long, at timestamp"


class Engine:
    """All state is in the store; one engine at a time writes to it."""

    def __init__(self, spark: SparkSession, root: str, profile: Profile = LAKEHOUSE, assistant=None, webhook: str | None = None, catalogue: Sequence[Rule] = RULES, alerts: Sequence[sentinel.AlertRule] = sentinel.ALERTS):
        """catalogue and alerts may come from files (`sources.files`)."""
        self.catalogue, self.alert_rules = tuple(catalogue), tuple(alerts)
        self.spark, self.profile, self.root = spark, profile, root.rstrip("/")
        self.store = Store(spark, f"{self.root}/tables")
        self.assistant, self.webhook = Budgeted(assistant), webhook

    # --- ingest ---------------------------------------------------------------------------------------------------
    def landing(self, source: str, entity: str) -> DataFrame:
        name = f"{entity}*.csv" if self.profile.many_files else f"{entity}.csv"
        return read_csv(self.spark, f"{self.root}/landing/{source}/{name}", source_file=self.profile.many_files)

    def ingest(self) -> tuple[DataFrame, DataFrame]:
        """Raw CSV to bronze, personal data to the vault; gives the canonical extracts."""
        found = {e: [] for e in ("vendors", "invoices")}
        for source in config.SOURCES:
            for entity in found:
                found[entity].append(standardize.canonical(self.landing(source, entity), source, entity))
        vendors, invoices = (union_all(found[e]) for e in ("vendors", "invoices"))
        return self.take(vendors, invoices)

    def take(self, vendors: DataFrame, invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The same for extracts that are there already."""
        self.store.write("pii_vault", standardize.vault(vendors))
        self.store.write("bronze_vendors", vendors)
        self.store.write("bronze_invoices", invoices)
        return self.store.read("bronze_vendors"), self.store.read("bronze_invoices")

    # --- library --------------------------------------------------------------------------------------------------
    def history(self) -> DataFrame:
        return self.store.read("rule_library", library.SCHEMA)

    def approve(self, items: DataFrame, by: str, source: str = "steward", note: str = "", run_id: str = "") -> None:
        self.store.append("rule_library", library.approve(self.history(), items, by, _now(), source, run_id, note))

    def retire(self, item_id: str, by: str, note: str = "") -> None:
        self.store.append("rule_library", library.retire(self.history(), item_id, by, _now(), note))

    def rules(self) -> list[Rule]:
        """The catalogue, the rules of the library with their mode, and the anomaly check."""
        rows = library.active(self.history(), "dq_rule").select("item_id", "definition").collect()
        own = [Rule(**{**json.loads(r["definition"]), "id": r["item_id"], "values": tuple(json.loads(r["definition"]).get("values") or ())}) for r in rows]
        return [*self.catalogue, *sorted(own, key=lambda r: r.id), ANOMALY]

    def mappings(self) -> config.Mappings:
        return library.mappings(self.history(), self.profile.mappings)

    def learn(self, vendors: DataFrame, invoices: DataFrame, run_id: str) -> DataFrame:
        """Valid and sure mappings go to the library; the others are proposals.  The assistant is asked once for
        each value that no rule settles, as far as its budget goes."""
        known, asked = self.mappings(), self.store.read("llm_mapping_cache", mapping_learner.ANSWERS)
        found = mapping_learner.learn(vendors, invoices, known, asked)
        if self.assistant.inner is not None:
            open_ = found.where(~F.col("approved") & (F.col("source") != "assistant") & (F.col("confidence") < config.FUZZY_APPROVE)).join(asked.select("domain", "raw"), ["domain", "raw"], "left_anti")
            answers = []
            for domain in ("city", "token", "currency"):
                rows = open_.where(F.col("domain") == domain).orderBy(F.desc("affected"), "raw").limit(40 * self.assistant.most_calls).collect()  # the budget's values
                options = sorted({o for r in rows for o in r["options"]})
                answers += [(domain, raw, c, p) for raw, (c, p) in ask_mappings(self.assistant, domain, [r["raw"] for r in rows], options).items()]
            if answers:
                self.store.append("llm_mapping_cache", self.spark.createDataFrame(answers, mapping_learner.ANSWERS))
                found = mapping_learner.learn(vendors, invoices, known, self.store.read("llm_mapping_cache"))
        self.store.write("learned_mappings", found)
        found = self.store.read("learned_mappings")
        items = mapping_learner.library_items(found.where("approved"))
        if not items.isEmpty():
            self.approve(items, "auto", "policy", run_id=run_id)
        return found.where(~F.col("approved")).drop("approved")

    # --- a run ----------------------------------------------------------------------------------------------------
    def run(self, as_of: date = config.AS_OF, extracts: tuple[DataFrame, DataFrame] | None = None, truth: DataFrame | None = None) -> dict:
        """Everything from landing to alerts.  All tables of a run appear together, when it has ended."""
        with self.store.commit():
            return self._run(as_of, extracts, truth)

    def _run(self, as_of: date, extracts: tuple[DataFrame, DataFrame] | None, truth: DataFrame | None) -> dict:
        run_id, put = uuid.uuid4().hex[:12], self.store.write
        raw_vendors, raw_invoices = self.take(*extracts) if extracts else self.ingest()
        proposals = self.learn(raw_vendors, raw_invoices, run_id) if self.profile.library_rules else None
        known = self.mappings()
        put("silver_vendor", standardize.vendors(raw_vendors, known))
        vendors = self.store.read("silver_vendor")
        put("silver_invoice", standardize.apply_fixes(standardize.invoices(raw_invoices, known), vendors, library.record_fixes(self.history())))
        invoices = self.store.read("silver_invoice")
        put("dq_profile", profiling.profile(vendors, "silver_vendor", ["vendor_name", "country_raw", "tax_id", "city", "email_domain"]))
        every = self.rules()
        put("invoice_context", rules.with_context(invoices, vendors))
        context = self.store.read("invoice_context")
        put("silver_dq_failures", rules.failures(vendors, context, every, as_of))
        put("dq_scorecard", rules.scorecard(vendors, context, every, as_of))
        flags, card = self.store.read("silver_dq_failures"), self.store.read("dq_scorecard")
        before = self.store.read("dq_scorecard_history", card.withColumn("run_id", F.lit("")).schema)
        pairs = self._match(vendors)
        edges = pairs.where("merge").select("left_key", "right_key", F.col("decided_by").alias("reason"), "score")
        if self.profile.constrained:
            clusters, edges = components.constrained_clusters(vendors, edges, library.cannot_links(self.history()))
            edges = edges.where("accepted").drop("accepted")
        else:
            clusters = components.clusters(vendors, edges)
        past = self.store.read("gold_vendor_xref_history", "master_key string, record_key string, run_no long")
        previous = matching.latest(past, ["record_key"], ["run_no", "master_key"]) if self.store.exists("gold_vendor_xref_history") else None
        gold, xref = golden.build(vendors, clusters, previous, past)
        put("gold_vendor", gold)
        put("gold_vendor_xref", xref)
        gold, xref = self.store.read("gold_vendor"), self.store.read("gold_vendor_xref")
        run_no = int(past.agg(F.coalesce(F.max("run_no"), F.lit(0).cast("long"))).first()[0]) + 1
        self.store.append("gold_vendor_xref_history", xref.select("master_key", "record_key", F.lit(run_no).cast("long").alias("run_no")))
        put("gold_merge_edges", edges.withColumn("run_id", F.lit(run_id)))
        put("gold_cluster_alerts", golden.cluster_alerts(vendors, xref).withColumn("run_id", F.lit(run_id)))
        blocking = [r for r in rules.of_entity(every, "invoice") if r.mode == "enforce"]
        blocking = blocking if self.profile.library_rules else [r for r in blocking if r in self.catalogue or r is ANOMALY]
        put("gold_spend_fact", spend.fact(rules.valid_invoices(context, blocking, as_of, invoices.columns), xref))
        put("quarantine_invoice", rules.quarantine(context, blocking, as_of, invoices.columns))
        found = self.triage(flags, vendors, invoices, every, pairs, proposals)
        metrics = sentinel.run_metrics(vendors, invoices, flags, card, self.store.read("quarantine_invoice"), self.store.read("gold_cluster_alerts")).first().asDict()
        alerts = self._watch(run_id, metrics, vendors, invoices, flags, card, before)
        self.store.append("dq_scorecard_history", card.withColumn("run_id", F.lit(run_id)))
        out = {"run_id": run_id, **metrics, "patterns": found.count(), "golden_vendors": gold.count(), "alerts": alerts, "assistant_calls": self.assistant.calls}
        if truth is not None:
            out |= evaluate.pairwise(xref, truth).first().asDict()
        self._log(run_id, "run", "finished", json.dumps(json_safe(out)), metrics["records"])
        return out

    def export(self, folder: str | None = None) -> list[str]:
        """The tables of each layer as CSV folders and the last run's metrics as JSON; gives the paths."""
        folder = folder or f"{self.root}/export"
        out = export(self.store, folder)
        last = self.store.read("agent_events", EVENTS).where("stage = 'run' AND action = 'finished'").orderBy(F.desc("at")).first()
        if last is not None:
            out.append(f"{folder}/reports/metrics.json")
            report(self.store, out[-1], json.loads(last["detail"]))
        return out

    def read_decisions(self, path: str) -> int:
        """Add the stewards' decisions of a CSV file that aren't in the table yet; gives their number."""
        told = self.store.read("steward_decisions", library.DECISIONS)
        new = decisions(self.store, path).join(told, ["left_key", "right_key", "decision", "reviewer"], "left_anti").select(told.columns)
        if n := new.count():
            self.store.append("steward_decisions", new)
        return n

    def _match(self, vendors: DataFrame) -> DataFrame:
        scored = matching.score_pairs(vendors, matching.candidate_pairs(vendors))
        told = self.store.read("llm_pair_cache", OPINIONS)
        pairs = matching.with_opinions(scored, vendors, told)
        match_rules = library.match_rules(self.history())
        if self.assistant.inner is not None:
            rows = matching.unanswered(pairs, match_rules, 10 * self.assistant.most_calls)
            asked = [{"fingerprint": r["fingerprint"], "text": f"{r['left_name']} / {r['right_name']}: {r['explanation']}"} for r in rows.dropDuplicates(["fingerprint"]).collect()]  # bounded by the budget of calls
            if said := ask_pairs(self.assistant, asked):
                rows = [(s["fingerprint"], s["decision"], s["confidence"], s["explanation"], "assistant", _now()) for s in said]
                self.store.append("llm_pair_cache", self.spark.createDataFrame(rows, OPINIONS))
                pairs = matching.with_opinions(scored, vendors, self.store.read("llm_pair_cache"))
        self.store.write("silver_match_pairs", self._decided(pairs))
        pairs = self.store.read("silver_match_pairs")
        self.store.write("review_queue", matching.review_queue(pairs))
        return pairs

    def _decided(self, pairs: DataFrame) -> DataFrame:
        steward = self.store.read("steward_decisions", library.DECISIONS)
        return matching.decide(pairs, steward, library.match_rules(self.history()), self.profile.steward_any_band)

    def judged(self, vendors: DataFrame, pairs: DataFrame) -> DataFrame:
        """Candidate pairs with scores, opinions that are there already, and decisions."""
        return self._decided(matching.with_opinions(matching.score_pairs(vendors, pairs), vendors, self.store.read("llm_pair_cache", OPINIONS)))

    def triage(self, flags: DataFrame, vendors: DataFrame, invoices: DataFrame, every: list[Rule], pairs: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
        done = library.acknowledged(self.history())
        dq = patterns.dq_patterns(flags, vendors, invoices, every, done)
        match = patterns.match_patterns(pairs.where(F.col("decided_by").isin("rules", "rules+ai")))
        parts = [dq, match]
        if proposals is not None:
            parts.append(patterns.mapping_patterns(proposals))
            self.store.write("steward_mappings", patterns.mapping_items(proposals, parts[-1]))
        self.store.write("steward_items", dq.select("pattern_id", "item_id", "kind", "rule_id", "source_system", "signature", F.lit(None).cast("string").alias("decision"), "affected_records", "confidence").unionByName(
            match.select("pattern_id", "item_id", "kind", F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("source_system"), "signature", "decision", "affected_records", "confidence")))
        out = patterns.open_patterns(parts, self.store.read("pattern_decisions", PATTERN_DECISIONS), done)
        self.store.write("steward_patterns", out)
        return self.store.read("steward_patterns")

    def _watch(self, run_id: str, metrics: dict, vendors: DataFrame, invoices: DataFrame, flags: DataFrame, card: DataFrame, before: DataFrame) -> list[str]:
        """Append this run's metrics; raise what the alert rules find against the run before."""
        at, schema = _now(), "run_id string, run_at timestamp, object string, metric string, value double"
        names = ("pass_rate", "anomalies", "worst_rule_pass_rate", "quarantine_rate", "suspect_golden_records")
        rows = [(run_id, at, "run", n, float(metrics[n])) for n in names]
        keys = vendors.select("record_key").unionByName(invoices.select("record_key"))
        bad = flags.select("record_key").distinct().withColumn("_bad", F.lit(1))
        by_source = keys.join(bad, "record_key", "left").groupBy(F.split_part("record_key", F.lit(":"), F.lit(1)).alias("s")).agg(F.round(1 - F.count("_bad") / F.count("*"), 4).alias("v"))
        rows += [(run_id, at, r["s"], "source_dq_score", float(r["v"])) for r in by_source.collect()]  # one for each source
        self.store.append("dq_run_metrics", self.spark.createDataFrame(rows, schema))
        raised = sentinel.history_alerts(self.store.read("dq_run_metrics"), self.alert_rules).where(F.col("run_at") == F.lit(at)).collect()
        last = before.agg(F.max_by("run_id", "run_id")).first()[0]
        grown = ", ".join(f"{r['rule_id']} +{r['delta']}" for r in sentinel.rule_deltas(card, before.where(F.col("run_id") == last)).collect()) if last else ""
        cause = f"Largest increases in failures: {grown}." if grown else f"Weakest rule this run: {metrics['worst_rule']}."
        by_id, out = {r.id: r for r in self.alert_rules}, []
        for r in raised:
            rule = by_id[r["alert_id"]]
            why, action = ask_cause(self.assistant, f"{rule.name} ({rule.condition} {rule.threshold}), value {r['value']}", metrics, grown) or (cause, sentinel.ACTIONS[rule.metric])
            text = sentinel.message(rule, r["object"], why, action)
            out.append((run_id, at, rule.id, rule.name, r["object"], rule.severity, rule.metric, r["value"], why, action, self._notify(text)))
        if out:
            kinds = "run_id string, raised_at timestamp, alert_id string, name string, object string, severity string, metric string, value double, cause string, action string, webhook_sent boolean"
            self.store.append("alerts", self.spark.createDataFrame(out, kinds))
        return [a[2] for a in out]

    def _notify(self, text: str) -> bool:
        if not self.webhook:
            return False
        try:
            request = urllib.request.Request(self.webhook, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
            urllib.request.urlopen(request, timeout=10).close()
            return True
        except OSError:
            return False

    def _log(self, run_id: str, stage: str, action: str, detail: str, records: int = 0) -> None:
        self.store.append("agent_events", self.spark.createDataFrame([(run_id, stage, action, detail, records, _now())], EVENTS))

    # --- stewards -------------------------------------------------------------------------------------------------
    def decide_pattern(self, pattern_id: str, decision: str, reviewer: str, note: str = "", canonical: str | None = None) -> str:
        """Approve or reject a pattern: approving puts its items into the library, in one commit with the decision.  A
        question about one value needs a canonical one, which has to be allowed."""
        if decision not in DECISIONS:
            raise ValueError("decision is approve or reject")
        with self.store.commit():
            return self._decide_pattern(pattern_id, decision, reviewer, note, canonical)

    def _decide_pattern(self, pattern_id: str, decision: str, reviewer: str, note: str, canonical: str | None) -> str:
        head = self.store.read("steward_patterns").where(F.col("pattern_id") == pattern_id).first()
        if head is None:
            raise KeyError(pattern_id)
        if head["kind"] in ("mapping_batch", "value_mapping"):
            own = self.store.read("steward_mappings").where(F.col("pattern_id") == pattern_id)
            if decision == "approve":
                if head["kind"] == "value_mapping":
                    own = self._answered(own, canonical)
                self.approve(mapping_learner.library_items(own), reviewer, note=note)
            item = head["signature"]
        else:
            row = self.store.read("steward_items").where(F.col("pattern_id") == pattern_id).first()
            if decision == "approve":
                says = {
                    "acknowledge": {"rule_id": row["rule_id"], "source_system": row["source_system"], "signature": row["signature"]},
                    "record_fix": {"fix": "currency_from_vendor_country", "source_system": row["source_system"], "currency_raw": (row["signature"].split("'") + [""])[1]},
                    "match_rule": {"signature": row["signature"], "decision": row["decision"]},
                }[row["kind"]]
                one = [(row["item_id"], row["kind"], json.dumps(says, sort_keys=True), float(row["confidence"]), int(row["affected_records"]))]
                self.approve(self.spark.createDataFrame(one, "item_id string, kind string, definition string, confidence double, affected_records long"), reviewer, note=note)
            item = row["item_id"]
        done = [(pattern_id, item, head["kind"], decision, int(head["affected_records"]), reviewer, note, library.version(self.history()), _now())]
        self.store.append("pattern_decisions", self.spark.createDataFrame(done, PATTERN_DECISIONS))
        return item

    def _answered(self, own: DataFrame, canonical: str | None) -> DataFrame:
        """The one mapping of a question, with a canonical value that its domain allows: for a token the legal mark or any
        core word of the vendors' names, whatever was offered."""
        row = own.first()
        if row["domain"] == "token":
            words = profiling.vocabulary(self.store.read("bronze_vendors"), "vendor_name", self.mappings())
            ok = canonical == config.LEGAL_MARK or canonical is not None and not words.where((F.col("kind") == "core") & (F.col("token") == canonical)).isEmpty()
            allowed = [*row["options"], config.LEGAL_MARK]
        else:
            allowed = {"city": list(config.CITIES), "currency": list(config.VALID_CURRENCIES)}[row["domain"]]
            ok = canonical in allowed
        if not ok:
            raise ValueError(f"{canonical!r} is no allowed {row['domain']}; choose from {allowed[:10]}")
        return own.withColumn("canonical", F.lit(canonical)).withColumn("confidence", F.lit(1.0))

    def recommend_pair(self, left: str, right: str) -> dict:
        """What the rules advise for a pair, with its scores, or the assistant, with its reasons."""
        a, b = sorted((left, right))
        found = library.recommend(self.store.read("silver_match_pairs").where((F.col("left_key") == a) & (F.col("right_key") == b))).first()
        if found is None:
            raise KeyError((a, b))
        return {**found.asDict(), **(ask_recommendation(self.assistant, found.asDict()) or {})}

    def decide_pair(self, left: str, right: str, decision: str, reviewer: str, note: str = "") -> None:
        if decision not in ("match", "no_match", "unsure"):
            raise ValueError("decision is match, no_match or unsure")
        a, b = sorted((left, right))
        self._known_records(a, b)
        self.store.append("steward_decisions", self.spark.createDataFrame([(a, b, decision, reviewer, note, _now())], library.DECISIONS))

    def _known_records(self, *keys: str) -> None:
        found = {r["record_key"] for r in self.store.read("silver_vendor", "record_key string").where(F.col("record_key").isin(*keys)).select("record_key").distinct().collect()}
        if unknown := sorted(set(keys) - found):
            raise KeyError(f"unknown record {', '.join(unknown)}")
        if len(found) < len(keys):
            raise ValueError("a pair is two records")

    def unmerge(self, record_key: str, reviewer: str, note: str = "") -> int:
        """Keep a record apart from all others of its golden vendor; gives how many those are."""
        self._known_records(record_key)
        items = library.cannot_link_items(self.store.read("gold_vendor_xref"), record_key)
        n = items.count()
        if n:
            self.approve(items, reviewer, note=note)
        return n

    def explain(self, master_key: str) -> dict[str, list[dict]]:
        parts = library.explain(self.store.read("gold_vendor_xref"), self.store.read("gold_merge_edges"), self.store.read("gold_cluster_alerts"), master_key)
        return {n: [r.asDict() for r in df.collect()] for n, df in zip(("members", "merges", "alerts"), parts, strict=True)}  # of one golden vendor

    def draft_rule(self, sentence: str, accept: bool = False, override: bool = False, reviewer: str = "steward", as_of: date = config.AS_OF, note: str = "") -> dict:
        """A rule from a sentence: tried on silver, blocked if too many records fail, accepted in shadow mode."""
        tables = {"vendor": self.store.read("silver_vendor"), "invoice": self.store.read("invoice_context")}
        columns = {e: [c for c in df.columns if c[0] != "_"] for e, df in tables.items()}
        found = ask_rule(self.assistant, sentence, columns) or rules.heuristic_rule(sentence, columns)
        if found is None:
            return {"status": "not understood"}
        rule = Rule(library.next_rule_id(self.history()), mode="shadow", **found)
        rules.validate(rule, tables[rule.entity].columns)
        seen = rules.preview(rule, tables[rule.entity], as_of).first().asDict()
        status = "blocked" if seen["blocked"] and not override else "accepted" if accept else "previewed"
        if status == "accepted":
            self._store_rule(rule, reviewer, note)
        return {"status": status, "rule": asdict(rule), **seen}

    def _store_rule(self, rule: Rule, by: str, note: str = "") -> None:
        body = {k: v for k, v in asdict(rule).items() if k != "id"}
        self.approve(self.spark.createDataFrame([(rule.id, "dq_rule", json.dumps(body, sort_keys=True), 1.0, 0)], "item_id string, kind string, definition string, confidence double, affected_records long"), by, note=note)

    def promote(self, rule_id: str, by: str) -> None:
        from dataclasses import replace

        rule = next(r for r in self.rules() if r.id == rule_id)
        self._store_rule(replace(rule, mode="enforce"), by)

    def train(self, name: str = "matcher") -> dict:
        """Fit the matcher on what stewards have decided, and register it if it could be trained."""
        read = ("silver_match_pairs", "steward_decisions")
        out = learning.train_matcher(learning.training_set(self.store.read(read[0]), self.store.read(read[1], library.DECISIONS)))
        if out["trained"]:
            out["version"] = self.register(name, out, {t: self.store.version(t) for t in read})
        return out

    def register(self, name: str, model: dict, snapshots: dict[str, int]) -> int:
        """Add a model to the registry as its next version: features, weights, metrics and the numbers of the tables'
        manifests that it was trained on."""
        models = self.store.read("model_registry", MODELS)
        version = int(models.where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0).cast("long"))).first()[0]) + 1
        metrics = {k: model[k] for k in ("precision", "recall", "rows")}
        weights = {**model["coefficients"], learning.INTERCEPT: model["intercept"]}
        row = (name, version, json.dumps(list(model["coefficients"])), json.dumps(weights), json.dumps(metrics), json.dumps(snapshots, sort_keys=True), _now())
        self.store.append("model_registry", self.spark.createDataFrame([row], MODELS))
        return version

    def model(self, name: str = "matcher", version: int | None = None) -> dict:
        """A registered model, the newest if no version is given."""
        models = self.store.read("model_registry", MODELS).where(F.col("name") == name)
        found = (models if version is None else models.where(F.col("version") == version)).orderBy(F.desc("version")).first()
        if found is None:
            raise KeyError(f"{name} version {version}")
        parts = {k: json.loads(found[k]) for k in ("features", "weights", "metrics", "snapshots")}
        return {"name": name, "version": found["version"], **parts, "trained_at": found["trained_at"]}

    def submit(self, inbox: str, by: str, **fields) -> str:
        """Put one checked decision into a stored inbox; gives its id."""
        wanted = INBOXES[inbox]
        if set(fields) - {"canonical"} != set(wanted) or not all(str(v).strip() for v in (by, *fields.values())):
            raise ValueError(f"{inbox} takes {', '.join(wanted)}")
        for name, value in fields.items():
            if wanted.get(name) and value not in wanted[name]:
                raise ValueError(f"{name} is one of {', '.join(wanted[name])}")
        row = (uuid.uuid4().hex, json.dumps({**fields, "reviewer": by}, sort_keys=True), _now())
        self.store.append(f"inbox_{inbox}", self.spark.createDataFrame([row], "id string, fields string, submitted_at timestamp"))
        return row[0]

    def apply_inbox(self, inbox: str, rows: DataFrame | None = None) -> int:
        """Decisions from outside (rows) or from the stored inbox, each id once.  What a row changes and its mark, which
        says what came of it, are one commit: a run that stops leaves both or neither.  A row that can't be applied
        changes nothing, is marked as failed with the reason and doesn't hold up those behind it."""
        if rows is None:
            rows = self.store.read(f"inbox_{inbox}", "id string, fields string, submitted_at timestamp")
        todo = library.unseen(rows, self.store.read("inbox_processed", PROCESSED), inbox).dropDuplicates(["id"]).orderBy("id").collect()  # typed in by people
        mark = lambda r, status: self.store.append("inbox_processed", self.spark.createDataFrame([(inbox, str(r["id"]), status, _now())], PROCESSED))
        for r in todo:
            try:
                with self.store.commit():
                    fields = {**r.asDict(), **json.loads(r.asDict().get("fields") or "{}")}
                    mark(r, self._act(inbox, fields, f"inbox:{inbox}:{r['id']}"))
            except (KeyError, ValueError, TypeError, AnalysisException, IllegalArgumentException) as e:  # what a row itself can cause
                mark(r, f"failed: {e}")
        return len(todo)

    def _act(self, inbox: str, r: dict, note: str) -> str:
        """Do what a row asks for; gives what came of it."""
        if inbox == "pattern":
            self.decide_pattern(r["pattern_id"], r["decision"], r["reviewer"], note, r.get("canonical"))
        elif inbox == "pair":
            self.decide_pair(r["left_key"], r["right_key"], r["decision"], r["reviewer"], note)
        elif inbox == "unmerge":
            if not self.unmerge(r["record_key"], r["reviewer"], note):
                return "alone already"
        else:
            said = self.draft_rule(r["sentence"], True, False, r["reviewer"], note=note)
            preview = [(note, r["sentence"], said["status"], json.dumps(said, default=str, sort_keys=True), _now())]
            self.store.append("rule_previews", self.spark.createDataFrame(preview, "note string, sentence string, status string, result string, previewed_at timestamp"))
            return "applied" if said["status"] == "accepted" else said["status"]
        return "applied"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def simulated_review(engine: Engine, truth: DataFrame, reviewer: str = "simulated-steward") -> int:
    """Decide every open pair by the truth (record_key, true_vendor)."""
    side = lambda s: truth.select(F.col("record_key").alias(f"{s}_key"), F.col("true_vendor").alias(f"_{s}"))
    queue = engine.store.read("review_queue").select("left_key", "right_key").join(side("left"), "left_key").join(side("right"), "right_key")
    said = queue.select("left_key", "right_key", F.when(F.col("_left") == F.col("_right"), "match").otherwise("no_match").alias("decision"), F.lit(reviewer).alias("reviewer"), F.lit("").alias("note"), F.lit(_now()).alias("decided_at"))
    engine.store.append("steward_decisions", said)
    return said.count()


def ablation(spark: SparkSession, root: str, extracts: tuple[DataFrame, DataFrame], truth: DataFrame) -> list[dict]:
    """A: no matching; B: rules; C: rules and one round of approvals; D: what asking about every row would cost."""
    none = truth.select(F.col("record_key").alias("master_key"), "record_key")
    out = [{"step": "A", **evaluate.resolution(none, truth).first().asDict()}]
    engine = Engine(spark, root)
    for step in "BC":
        if step == "C":
            simulated_review(engine, truth)
            for r in engine.store.read("steward_patterns").where("kind IN ('acknowledge', 'record_fix')").select("pattern_id").collect():
                engine.decide_pattern(r["pattern_id"], "approve", "ablation")
        result = engine.run(extracts=extracts, truth=truth)
        out.append({"step": step, **evaluate.resolution(engine.store.read("gold_vendor_xref"), truth).first().asDict(), "precision": result["match_precision"], "recall": result["match_recall"]})
    pairs = engine.store.read("silver_match_pairs").count()
    out.append({"step": "D", "assistant_calls": extracts[0].count() + extracts[1].count() + pairs})
    report(engine.store, f"{engine.root}/reports/ablation.json", out)
    return out
