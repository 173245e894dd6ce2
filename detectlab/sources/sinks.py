"""Corpus sinks: each shapes corpus rows as a DataFrame and writes it with a Spark writer, part files in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.functions import draws as D
from detectlab.functions.text import let

CSV_COLUMNS = ("category", "plain_value", "variant_value", "technique", "generator", "transform_name", "has_keywords",
               "embedded_text")

# Columns a category's value goes to, and the field names of JSON records.
WIDE_COLUMNS = {
    "en": ("customer_id", "name", "email", "phone", "date_of_birth", "address", "sin", "card_number", "iban",
           "swift_bic", "aba_routing", "aws_key", "jwt", "notes"),
    "fr": ("id_client", "nom", "courriel", "telephone", "date_de_naissance", "adresse", "numero_assurance_sociale",
           "numero_carte", "iban", "code_swift", "routage_aba", "cle_aws", "jeton_jwt", "notes"),
}
CATEGORY_SLOT = {"email": 2, "phone": 3, "sin": 6, "ssn": 6, "credit_card": 7, "iban": 8, "swift_bic": 9,
                 "aba_routing": 10, "aws_key": 11, "jwt": 12}
RELATIONAL = {"email": ("customers", "email"), "phone": ("customers", "phone"), "sin": ("customers", "sin"),
              "ssn": ("customers", "sin"), "credit_card": ("transactions", "card_number"),
              "iban": ("accounts", "iban"), "swift_bic": ("accounts", "swift_bic")}
JSON_FIELDS = {"credit_card": "card_number", "ssn": "ssn", "sin": "sin", "iban": "iban", "swift_bic": "swift_bic",
               "aba_routing": "routing_number", "bitcoin": "btc_address", "ethereum": "eth_address", "email": "email",
               "phone": "phone", "us_passport": "passport_number"}
SQL_COLUMNS = ("card_number", "ssn", "sin", "iban", "swift_bic", "routing_number", "btc_address", "eth_address")
LOG_LEVELS = (("INFO", 0.5), ("WARN", 0.7), ("ERROR", 0.9), ("DEBUG", 1.0))

NAMES = {"en": ("John Smith", "Sarah Chen", "David Wilson", "Maria Garcia", "Emily Brown"),
         "fr": ("Jean Tremblay", "Marie Gagnon", "Luc Roy", "Sophie Bouchard", "Anne Fortin")}
STREETS = {"en": ("King Street", "Main Street", "Queen Street"), "fr": ("rue Principale", "rue Saint-Denis", "avenue du Parc")}
SERVICES = ("payment", "auth", "account", "report", "batch")
ACTIONS = {
    "credit_card": ("payment card={value}", "card {value} validated"), "ssn": ("identity check SSN={value}",),
    "sin": ("record updated SIN={value}",), "iban": ("transfer IBAN={value}",), "email": ("mail sent to email={value}",),
    "phone": ("message sent to phone={value}",), None: ("value processed: {value}", "record updated: {value}"),
}


def fillers(row_id: Column, seed: int = 42, language: str = "en") -> dict[str, Column]:
    """Fake columns: name, address, date, timestamp, amount, uuid."""
    uuid = D.symbols(seed, "fill.uuid", row_id, 32, "0123456789abcdef")
    return {
        "name": D.choice(seed, "fill.name", row_id, NAMES[language]),
        "address": F.concat_ws(" ", D.between(seed, "fill.house", row_id, 1, 999).cast("string"),
                               D.choice(seed, "fill.street", row_id, STREETS[language])),
        "date": F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), D.below(seed, "fill.date", row_id, 18250)),
                              "yyyy-MM-dd"),
        "timestamp": F.date_format(
            F.timestamp_seconds(F.lit(1767225600) + D.below(seed, "fill.ts", row_id, 31536000)), "yyyy-MM-dd HH:mm:ss"),
        "amount": F.format_string("%.2f", D.between(seed, "fill.amount", row_id, 1000, 500000) / F.lit(100.0)),
        "uuid": let(uuid, lambda u: F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4),
                                                F.substring(u, 17, 4), F.substring(u, 21, 12))),
    }


def csv_rows(corpus: DataFrame) -> DataFrame:
    """Eight text columns; no technique is an empty field, booleans are ``True`` and ``False``."""
    return corpus.select(*[
        F.when(F.col(c), "True").otherwise("False").alias(c) if c == "has_keywords"
        else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def write_csv(corpus: DataFrame, path: str) -> None:
    csv_rows(corpus).write.option("header", True).option("escape", '"').csv(path)


def _field_value() -> Column:
    """A typed field holds the bare value; a value inside a sentence stays out of it."""
    inside = F.coalesce(F.col("generator") == "context_injection", F.lit(False))
    return F.when(inside, F.col("plain_value")).otherwise(F.col("variant_value"))


def json_records(corpus: DataFrame, seed: int = 42) -> DataFrame:
    """entry_id and one JSON object: id, name, the typed field, notes for sentences, technique and family if any."""
    field = F.col("category")
    for category, name in JSON_FIELDS.items():
        field = F.when(F.col("category") == category, name).otherwise(field)
    inside = F.coalesce(F.col("generator") == "context_injection", F.lit(False))
    entry = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), v.alias("value"))
    fields = F.array_compact(F.array(
        entry("customer_id", F.concat(F.lit("CUST-"), F.col("entry_id").cast("string"))),
        entry("name", fillers(F.col("entry_id"), seed)["name"]),
        entry(field, _field_value()),
        F.when(inside, entry("notes", F.col("variant_value"))),
        F.when(F.col("technique").isNotNull(), entry("_evasion_technique", F.col("technique"))),
        F.when(F.col("technique").isNotNull(), entry("_generator", F.col("generator"))),
    ))
    return corpus.select("entry_id", F.to_json(F.map_from_entries(fields)).alias("record"))


def write_json(corpus: DataFrame, path: str, seed: int = 42) -> None:
    json_records(corpus, seed).select(F.col("record").alias("value")).write.text(path)


def wide_table(corpus: DataFrame, language: str = "en", seed: int = 42) -> DataFrame:
    """14 columns; the value stands in its category's column, sentences and other categories in notes."""
    names = WIDE_COLUMNS[language]
    fake = fillers(F.col("entry_id"), seed, language)
    default = {0: F.concat(F.lit("C-"), F.col("entry_id").cast("string")), 1: fake["name"], 4: fake["date"],
               5: fake["address"]}
    columns = []
    for i, name in enumerate(names[:-1]):
        column = default.get(i, F.lit(None).cast("string"))
        holders = [c for c, slot in CATEGORY_SLOT.items() if slot == i]
        if holders:
            column = F.when(F.col("category").isin(*holders), _field_value()).otherwise(column)
        columns.append(column.alias(name))
    inside = F.coalesce(F.col("generator") == "context_injection", F.lit(False))
    other = ~F.col("category").isin(*CATEGORY_SLOT)
    notes = F.when(inside | other, F.col("embedded_text"))
    return corpus.select(*columns, notes.alias(names[-1]))


def write_wide_parquet(corpus: DataFrame, path: str, language: str = "en", block_bytes: int = 1 << 20) -> None:
    """Small row groups, so that readers meet several."""
    wide_table(corpus, language).write.option("compression", "snappy").option("parquet.block.size", block_bytes).parquet(path)


def relational_tables(corpus: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """customers, transactions and accounts: each entry goes to its category's table and column, the rest to notes."""
    eid, value = F.col("entry_id"), _field_value()
    fake = fillers(eid, seed)
    cat = F.col("category")

    def where(table: str) -> Column:
        return cat.isin(*[c for c, (t, _) in RELATIONAL.items() if t == table])

    def slot(table: str, column: str) -> Column:
        return F.when(cat.isin(*[c for c, tc in RELATIONAL.items() if tc == (table, column)]), value).alias(column)

    rest = ~cat.isin(*RELATIONAL)
    return {
        "customers": corpus.filter(where("customers") | rest).select(
            eid.alias("id"), fake["name"].alias("name"), slot("customers", "email"), slot("customers", "phone"),
            slot("customers", "sin"), fake["date"].alias("date_of_birth"), fake["address"].alias("address"),
            F.when(rest, F.col("embedded_text")).alias("notes")),
        "transactions": corpus.filter(where("transactions")).select(
            eid.alias("id"), slot("transactions", "card_number"), fake["amount"].alias("amount"),
            fake["timestamp"].alias("ts")),
        "accounts": corpus.filter(where("accounts")).select(
            eid.alias("id"), slot("accounts", "iban"), slot("accounts", "swift_bic"), fake["name"].alias("owner")),
    }


def write_relational(corpus: DataFrame, path: str) -> None:
    for name, table in relational_tables(corpus).items():
        table.write.parquet(f"{path}/{name}")


def log_lines(corpus: DataFrame, seed: int = 42, start: int = 1776412800) -> DataFrame:
    """entry_id and one line in one of three layouts: plain, key=value, JSON."""
    eid = F.col("entry_id")
    u = D.uniform(seed, "log.level", eid)
    level = F.lit(LOG_LEVELS[-1][0])
    for name, upto in reversed(LOG_LEVELS[:-1]):
        level = F.when(u < upto, name).otherwise(level)
    pick = lambda texts: D.choice(seed, "log.action", eid, texts)
    action = pick(ACTIONS[None])
    for category, texts in ACTIONS.items():
        if category is not None:
            action = F.when(F.col("category") == category, pick(texts)).otherwise(action)
    stamp = F.date_format(F.timestamp_seconds(F.lit(start) + F.pmod(eid, F.lit(31536000))), "yyyy-MM-dd HH:mm:ss")
    parts = corpus.select(
        eid, "technique", stamp.alias("ts"), level.alias("level"),
        D.choice(seed, "log.service", eid, SERVICES).alias("service"),
        F.replace(action, F.lit("{value}"), F.col("variant_value")).alias("message"),
        D.between(seed, "log.ms", eid, 1, 500).alias("duration_ms"), D.below(seed, "log.layout", eid, 3).alias("layout"))
    line = F.when(F.col("layout") == 0, F.concat_ws(" ", "ts", "level", F.concat(F.lit("["), "service", F.lit("]")), "message"))
    line = line.when(F.col("layout") == 1, F.concat(
        F.concat_ws(" ", "ts", "level"), F.lit(" service="), "service", F.lit(' action="'), "message",
        F.lit('" duration_ms='), F.col("duration_ms").cast("string")))
    line = line.otherwise(F.to_json(F.struct(F.col("ts").alias("timestamp"), "level", "service", "message", "duration_ms")))
    tail = F.when(F.col("technique").isNotNull(), F.concat(F.lit("  # evasion: "), "technique")).otherwise("")
    return parts.select("entry_id", F.concat(line, tail).alias("line"))


def write_log(corpus: DataFrame, path: str) -> None:
    """Each entry's time is its own offset, so files need no global order."""
    log_lines(corpus).select(F.col("line").alias("value")).write.text(path)


def payment_rows(corpus: DataFrame, seed: int = 42) -> DataFrame:
    """One nested payment per entry; account, bank code and card stand in their own elements, the rest as free text."""
    eid, cat, value = F.col("entry_id"), F.col("category"), _field_value()
    fake = fillers(eid, seed)
    free = F.when(cat == "credit_card", F.concat(F.lit("Card: "), value)).when(
        ~cat.isin("iban", "swift_bic"), F.col("embedded_text"))
    return corpus.select(
        F.concat(F.lit("PMT-"), eid.cast("string")).alias("PmtInfId"), F.lit("TRF").alias("PmtMtd"),
        F.struct(fake["name"].alias("Nm")).alias("Dbtr"),
        F.struct(
            F.struct(F.concat(F.lit("E2E-"), eid.cast("string")).alias("EndToEndId")).alias("PmtId"),
            fake["amount"].alias("Amt"),
            F.struct(F.struct(F.when(cat == "iban", value).alias("IBAN")).alias("Id")).alias("CdtrAcct"),
            F.struct(F.struct(F.when(cat == "swift_bic", value).alias("BIC")).alias("FinInstnId")).alias("CdtrAgt"),
            F.struct(free.alias("Ustrd")).alias("RmtInf"),
        ).alias("CdtTrfTxInf"))


def write_payments(corpus: DataFrame, path: str) -> None:
    payment_rows(corpus).write.format("xml").option("rowTag", "PmtInf").option("rootTag", "CstmrCdtTrfInitn").save(path)


def sql_table(corpus: DataFrame, seed: int = 42) -> DataFrame:
    """The wide table of a SQL target: the category's column, any other category in sensitive_val; batch of 20."""
    eid, cat = F.col("entry_id"), F.col("category")
    fake = fillers(eid, seed)
    by_field = {name: [c for c, f in JSON_FIELDS.items() if f == name] for name in SQL_COLUMNS}
    typed = [c for cats in by_field.values() for c in cats]
    return corpus.select(
        eid.alias("id"), fake["name"].alias("name"),
        F.when(~cat.isin(*typed), F.col("embedded_text")).alias("sensitive_val"),
        *[F.when(cat.isin(*cats), _field_value()).alias(name) for name, cats in by_field.items()])



# Layouts of text documents: header, line and footer. ``{category}`` and ``{text}`` are filled per line.
LAYOUTS = {
    "generic": ("DOCUMENT {doc}", "[{category}] {text}", "END"),
    "invoice": ("INVOICE {doc}", "Item - {text}", "Total due on receipt"),
    "statement": ("ACCOUNT STATEMENT {doc}", "Entry: {text}", "End of statement"),
    "hr_record": ("EMPLOYEE RECORD {doc}", "Field {category}: {text}", "Human resources"),
    "audit_report": ("AUDIT REPORT {doc}", "Finding: {text}", "Auditor sign-off"),
    "source_code": ("# module {doc}", "{category} = \"{text}\"", "# end"),
    "config_file": ("[section {doc}]", "{category} = {text}", "; end"),
    "chat_log": ("Chat {doc}", "user: {text}", "(chat closed)"),
    "medical_record": ("PATIENT RECORD {doc}", "Note ({category}): {text}", "Clinic"),
    "env_file": ("# env {doc}", "export {category}={text}", "# end"),
    "secrets_file": ("--- secrets {doc}", "{category}: {text}", "---"),
    "code_with_secrets": ("def configure_{doc}():", "    {category} = \"{text}\"", "    return None"),
}
# Filler lines per n entries.
NOISE = {"low": 10, "medium": 5, "high": 2}
NOISE_LINES = ("Reviewed without remarks.", "See the attached schedule.", "Processed in the usual way.")


def assemble_documents(corpus: DataFrame, layout: str = "generic", noise: str = "medium", per_document: int = 50) -> DataFrame:
    """Documents of ``per_document`` entries: doc, text. A group is bounded by that number, so one task holds few lines.

    An entry's document and place come from its hash order within a hash range, so no global numbering is needed.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; one of {', '.join(LAYOUTS)}")
    if noise not in NOISE:
        raise ValueError(f"unknown noise level {noise!r}; one of {', '.join(NOISE)}")
    header, line, footer = LAYOUTS[layout]
    doc = F.floor(F.col("entry_id") / per_document)
    text = F.replace(F.replace(F.lit(line), F.lit("{category}"), F.col("category")), F.lit("{text}"), F.col("embedded_text"))
    extra = F.when(F.pmod(F.col("entry_id"), F.lit(NOISE[noise])) == 0, F.concat(F.lit("\n"), F.element_at(
        F.array(*[F.lit(n) for n in NOISE_LINES]), (F.pmod(F.col("entry_id"), F.lit(len(NOISE_LINES))) + 1).cast("int"))))
    lines = corpus.select(doc.alias("doc"), F.struct(
        "entry_id", "category", F.concat(text, F.coalesce(extra, F.lit(""))).alias("line")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n")
    return lines.groupBy("doc").agg(F.count("*").alias("lines"), body.alias("body")).select(
        "doc", "lines", F.concat_ws("\n", F.replace(F.lit(header), F.lit("{doc}"), F.col("doc").cast("string")), "body",
                                    F.lit(footer)).alias("text"))


def write_documents(corpus: DataFrame, path: str, layout: str = "generic", noise: str = "medium") -> None:
    assemble_documents(corpus, layout, noise).select(F.col("text").alias("value")).write.option("lineSep", "\n\n").text(path)


def edm_rows(values: DataFrame) -> DataFrame:
    return values.select("category", "label", "value")


def write_dictionary_csv(values: DataFrame, path: str) -> None:
    edm_rows(values).write.option("header", True).option("escape", '"').csv(path)


def write_dictionary_json(values: DataFrame, path: str) -> None:
    """JSON lines; the reader also takes documents with a ``values`` array."""
    edm_rows(values).write.json(path)


SINK_FORMATS: Sequence[str] = ("csv", "json", "parquet", "relational", "log", "xml", "txt")


def write_corpus(corpus: DataFrame, fmt: str, path: str) -> None:
    writers = {"csv": write_csv, "json": write_json, "parquet": write_wide_parquet, "relational": write_relational,
               "log": write_log, "xml": write_payments, "txt": write_documents}
    if fmt not in writers:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(writers)}")
    writers[fmt](corpus, path)
