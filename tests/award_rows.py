"""Small all-text award records for the tests."""

BASE = {
    "contract_amount": "100.00",
    "approved_budget": "120.00",
    "item_budget": "120.00",
    "quantity": "2",
    "line_item_no": "1",
    "contract_duration": "30",
    "published_date": "45600",
    "closing_date": "45610",
    "award_published_date": "45620",
    "award_date": "45630",
    "proceed_date": "45640",
    "effectivity_date": "45650",
    "end_date": "45680",
    "agency": "DEPARTMENT OF HEALTH",
    "notice_title": "Supply of paper",
    "item_name": "Bond Paper",
    "item_desc": "A4 white",
    "award_title": "Paper",
    "awardee": "ACME",
    "unspsc_code": "14",
    "unspsc_desc": "Paper",
    "region": "NCR",
    "award_ref": "1",
    "quarter": "2025-Q1",
}


def bronze(spark, *changes, columns=None):
    """One record per change dict, on top of the base record."""
    names = columns or [*BASE, *sorted({k for c in changes for k in c} - set(BASE))]
    data = [tuple({**BASE, **c}.get(n) for n in names) for c in changes]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
