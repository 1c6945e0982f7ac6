"""Source columns to the canonical vendor and invoice tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.config import COUNTRIES, SOURCES, Mappings
from quarrystone.functions import privacy, text
from quarrystone.operators import mapped
from quarrystone.sources.extract import DATE_PATTERNS

# Canonical field, and the column of it in each source.
VENDOR_FIELDS = {
    "source_vendor_id": ("LIFNR", "VENDOR_ID", "VendorAccountNumber"),
    "vendor_name": ("NAME1", "VENDOR_NAME", "VendorOrganizationName"),
    "street": ("STRAS", "ADDRESS_LINE1", "AddressStreet"),
    "city_raw": ("ORT01", "CITY", "AddressCity"),
    "country_raw": ("LAND1", "COUNTRY", "AddressCountryRegionId"),
    "tax_id_raw": ("STCD1", "TAX_REGISTRATION_NUM", "TaxExemptNumber"),
    "phone_raw": ("TELF1", "PHONE", "PrimaryPhone"),
    "email_raw": ("SMTP_ADDR", "EMAIL", "PrimaryEmail"),
    "bank_raw": ("BANKN", "BANK_ACCOUNT_NUM", "PrimaryBankAccountNumber"),
}
INVOICE_FIELDS = {
    "invoice_no": ("BELNR", "INVOICE_NUM", "InvoiceId"),
    "source_vendor_id": ("LIFNR", "VENDOR_ID", "VendorAccount"),
    "invoice_date_raw": ("BLDAT", "INVOICE_DATE", "InvoiceDate"),
    "amount_raw": ("WRBTR", "INVOICE_AMOUNT", "InvoiceAmount"),
    "currency_raw": ("WAERS", "INVOICE_CURRENCY_CODE", "InvoiceCurrency"),
}


def source_schema(source: str, entity: str) -> dict[str, str]:
    """canonical field: source column."""
    at = SOURCES.index(source)
    return {k: v[at] for k, v in (VENDOR_FIELDS if entity == "vendors" else INVOICE_FIELDS).items()}


def canonical(raw: DataFrame, source: str, entity: str) -> DataFrame:
    """Rename a source's columns; other columns stay behind."""
    out = raw.select(F.lit(source).alias("source"), *[F.col(c).alias(k) for k, c in source_schema(source, entity).items()])
    if entity == "vendors":
        return out.withColumn("record_key", F.concat("source", F.lit(":"), "source_vendor_id"))
    return out.withColumn("record_key", F.concat("source", F.lit(":INV:"), "invoice_no")).withColumn("vendor_record_key", F.concat("source", F.lit(":"), "source_vendor_id"))


def raw_field(frames: dict[str, DataFrame], entity: str, field: str) -> DataFrame:
    """One canonical field of all sources' raw tables, as (source, value)."""
    parts = [df.select(F.lit(s).alias("source"), F.col(source_schema(s, entity)[field]).alias("value")) for s, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def vendors(raw: DataFrame, mappings: Mappings, protect: bool = True) -> DataFrame:
    """Canonical extract rows to silver_vendor, in one projection, besides joins with many mappings."""
    phone, email, bank = text.phone(F.col("phone_raw")), text.email(F.col("email_raw")), text.bank_account(F.col("bank_raw"))
    masked = {"phone": privacy.mask_phone(phone), "email": privacy.mask_email(text.blank_to_null(F.col("email_raw"))), "bank_account": privacy.mask_bank(bank)}
    plain = {"phone": phone, "email": email, "bank_account": bank}
    shown = masked if protect else plain
    raw = mapped.with_value(mapped.with_names(raw, mappings), mappings, "city", "city_raw", "_city")
    return raw.select(
        "record_key",
        F.col("source").alias("source_system"),
        "source_vendor_id",
        text.display_name(F.col("vendor_name")).alias("vendor_name"),
        F.col("_norm").alias("vendor_name_norm"),
        text.blank_to_null(F.col("street")).alias("street"),
        F.coalesce("_city", text.city(F.col("city_raw"), mappings.city)).alias("city"),
        text.blank_to_null(F.col("country_raw")).alias("country_raw"),
        text.country_iso2(F.col("country_raw")).alias("country_iso2"),
        text.tax_id(F.col("tax_id_raw")).alias("tax_id"),
        *[v.alias(k) for k, v in shown.items()],
        privacy.token(phone, "phone").alias("phone_token"),
        privacy.token(email, "email").alias("email_token"),
        privacy.token(bank, "bank").alias("bank_token"),
        text.email_domain(email).alias("email_domain"),
    )


def vault(raw: DataFrame) -> DataFrame:
    """(record_key, field, raw_value): the raw personal data, to be kept apart."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_raw").alias("raw_value")) for f in ("phone", "email", "bank")])
    return raw.select("record_key", F.explode(fields).alias("x")).select("record_key", "x.field", "x.raw_value").where("raw_value <> ''")


def invoice_date() -> Column:
    return F.coalesce(*[F.when(F.col("source") == s, text.date_of(F.initcap("invoice_date_raw"), p)) for s, p in DATE_PATTERNS.items()])


def invoices(raw: DataFrame, mappings: Mappings) -> DataFrame:
    """Canonical extract rows to silver_invoice, in one projection, besides joins with many mappings."""
    raw = mapped.with_value(raw, mappings, "currency", "currency_raw", "_currency")
    return raw.select(
        "record_key",
        F.col("source").alias("source_system"),
        "invoice_no",
        "source_vendor_id",
        "vendor_record_key",
        text.blank_to_null(F.col("invoice_date_raw")).alias("invoice_date_raw"),
        invoice_date().alias("invoice_date"),
        text.amount(F.col("amount_raw")).alias("amount"),
        text.blank_to_null(F.col("currency_raw")).alias("currency_raw"),
        F.coalesce("_currency", text.currency(F.col("currency_raw"), mappings.currency)).alias("currency"),
        F.lit(None).cast("string").alias("fixed_by"),
    )


def apply_fixes(invoices: DataFrame, vendors: DataFrame, fixes: list[dict]) -> DataFrame:
    """Approved record fixes: a bad currency becomes the one of the vendor's country.  fixes: id, source (or *),
    raw; a later fix wins.  The list is a steward's, so it is a literal; vendors are joined by key."""
    if not fixes:
        return invoices
    by_country = {c: v[3] for c, v in COUNTRIES.items()}
    country = vendors.groupBy(F.col("record_key").alias("vendor_record_key")).agg(F.max("country_iso2").alias("_country"))
    raw = F.coalesce("currency_raw", F.lit("(blank)"))
    which = [F.when((F.col("source_system") == f["source"]) | F.lit(f["source"] == "*"), F.when(raw == f["raw"], F.lit(f["id"]))) for f in reversed(fixes)]
    new = text.mapped(by_country, F.col("_country"))
    out = invoices.join(country, "vendor_record_key", "left").withColumn("_fix", F.when(new.isNotNull(), F.coalesce(*which)))
    out = out.withColumn("currency", F.when(F.col("_fix").isNotNull(), new).otherwise(F.col("currency"))).withColumn("fixed_by", F.coalesce("_fix", "fixed_by"))
    return out.select(invoices.columns)

