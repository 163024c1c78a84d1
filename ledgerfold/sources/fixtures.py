"""Evaluation cases: pairs of generated documents with their expected outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, reproduced as test data that results depend on: templates and cases (bucket, contract name, W-9 name, tax id, terms, liability).
CONTRACT = 'VENDOR SERVICES AGREEMENT\n\nThis agreement is entered into between Buyer and {} ("Vendor").\n\nPayment Terms: {}\n\nLiability: {}\n'
W9 = "FORM W-9 -- Request for Taxpayer Identification Number\n\n1. Name of entity: {}\n2. Taxpayer Identification Number (EIN): {}\n"
STANDARD, MUTUAL, FEES, CAPPED = "Standard indemnification clause.", "Mutual indemnification for third-party claims.", "Limited to fees paid in prior 12 months.", "Liability capped at contract value."
CASES = [
    ("clean", "Acme Corp", "Acme Corp", "12-3456789", "Net 30", STANDARD),
    ("clean", "Blue Ridge Logistics Inc.", "Blue Ridge Logistics Inc.", "23-4567891", "Net 45", FEES),
    ("clean", "Summit Peak Freight LLC", "Summit Peak Freight LLC", "34-5678912", "Net 30", MUTUAL),
    ("clean", "Golden Gate Supplies Co.", "Golden Gate Supplies Co.", "45-6789123", "Net 60", STANDARD),
    ("clean", "Northwind Traders Ltd.", "Northwind Traders Ltd.", "56-7891234", "Net 30", CAPPED),
    ("clean", "Pioneer Manufacturing Inc.", "Pioneer Manufacturing Inc.", "67-8912345", "Net 45", STANDARD),
    ("clean", "Cascade Software Solutions LLC", "Cascade Software Solutions LLC", "78-9123456", "Net 15", MUTUAL),
    ("clean", "Redwood Consulting Group", "Redwood Consulting Group", "89-1234567", "Net 30", FEES),
    ("clean", "Silverline Logistics Corp.", "Silverline Logistics Corp.", "90-2345678", "Net 30", CAPPED),
    ("clean", "Harborview Industries Inc.", "Harborview Industries Inc.", "11-2233445", "Net 45", STANDARD),
    ("mismatch", "Zenith Marketing Partners", "Apex Creative Group", "22-3344556", "Net 30", STANDARD),
    ("mismatch", "TransGlobal Shipping Co.", "Coastal Freight Solutions", "33-4455667", "Net 30", STANDARD),
    ("mismatch", "BrightPath Consulting LLC", "Horizon Advisory Services", "44-5566778", "Net 30", STANDARD),
    ("mismatch", "Ironclad Security Systems", "Guardian Protective Services", "55-6677889", "Net 30", STANDARD),
    ("mismatch", "Nova Data Systems Inc.", "Stellar Analytics LLC", "66-7788990", "Net 30", STANDARD),
    ("formatting", "Acme Corp", "Acme Corporation", "77-8899001", "Net 30", STANDARD),
    ("formatting", "J&K Supplies", "J and K Supplies, LLC", "88-9900112", "Net 30", STANDARD),
    ("formatting", "Global Tech Solutions", "Global Technology Solutions, Inc.", "99-0011223", "Net 30", STANDARD),
    ("malformed", "Driftwood Trading Co.", "Driftwood Trading Co.", "[illegible]", "Net 30", STANDARD),
    ("malformed", "Meridian Analytics Group", "", "N/A", "Net 30", STANDARD),
]
EXPECTED = {"clean": (True, "approved"), "formatting": (True, "approved"), "mismatch": (False, "needs_review"), "malformed": (None, "needs_review")}


def cases(spark: SparkSession) -> DataFrame:
    """id, bucket, contract_text, w9_text, expected_entity_match, expected_decision."""
    rows, count = [], dict.fromkeys(EXPECTED, 0)
    for bucket, name, w9_name, tax_id, terms, liability in CASES:
        count[bucket] += 1
        rows.append((f"{bucket}-{count[bucket]:02d}", bucket, CONTRACT.format(name, terms, liability), W9.format(w9_name, tax_id), *EXPECTED[bucket]))
    return spark.createDataFrame(rows, "id string, bucket string, contract_text string, w9_text string, expected_entity_match boolean, expected_decision string")


def cases_of(rows: DataFrame, key: str, name: Column) -> DataFrame:
    """The cases for every row of a table, whose name stands before each company's: key and the columns of cases(), ids with the key.

    A name that is missing from a case stays missing. The texts are made where the rows are.
    """
    at, numbered = dict.fromkeys(EXPECTED, 0), []
    for bucket, *fields in CASES:
        at[bucket] += 1
        match, decision = EXPECTED[bucket]
        cells = dict(zip(("id", "bucket", "name", "w9_name", "tax_id", "terms", "liability", "decision"), (f"{bucket}-{at[bucket]:02d}", bucket, *fields, decision), strict=True))
        numbered.append(F.struct(*(F.lit(v).alias(k) for k, v in cells.items()), F.lit(match).cast("boolean").alias("match")))
    case = rows.select(F.col(key), name.alias("__name"), F.explode(F.array(*numbered)).alias("__c"))
    named = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat("__name", F.lit(" "), F.col(c)))
    contract = F.format_string(CONTRACT.replace("{}", "%s"), named("__c.name"), F.col("__c.terms"), F.col("__c.liability"))
    w9 = F.format_string(W9.replace("{}", "%s"), named("__c.w9_name"), F.col("__c.tax_id"))
    return case.select(key, F.concat(F.col(key).cast("string"), F.lit("/"), F.col("__c.id")).alias("id"), F.col("__c.bucket").alias("bucket"), contract.alias("contract_text"), w9.alias("w9_text"), F.col("__c.match").alias("expected_entity_match"), F.col("__c.decision").alias("expected_decision"))
