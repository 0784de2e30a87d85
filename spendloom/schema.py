"""Column names and types of the award tables.

Inside the package every column has a snake_case name; the headings that workbooks and users' SQL carry
are translated once, at the edges, by ``to_internal`` and ``to_headings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Published column headings of the award table, keyed by internal name.
HEADINGS = {
    "item_id": "item_id",
    "government_branch": "Government Branch",
    "classification": "Classification",
    "org_group": "PE Organization Type (Grouped)",
    "procurement_mode": "Procurement Mode",
    "awardee_size": "Awardee Size",
    "quarter": "quarter",
    "agency": "Procuring Entity (PE)",
    "region": "Region",
    "contract_amount": "Contract Amount",
    "approved_budget": "Approved Budget of the Contract",
    "award_date": "Award Date",
    "awardee": "Awardee Organization Name",
    "notice_title": "Notice Title",
    "item_name": "Item Name",
    "award_ref": "Award Reference No.",
    "province": "Province",
    "city": "City/Municipality",
    "area_of_delivery": "Area of Delivery",
    "awardee_province": "Province of Awardee",
    "awardee_city": "City/Municipality of Awardee",
    "awardee_region": "Region of Awardee",
    "awardee_country": "Country of Awardee",
    "org_type": "PE Organization Type",
    "business_category": "Business Category",
    "joint_venture": "Awardee Joint Venture",
    "item_budget": "Item Budget",
    "funding_source": "Funding Source",
    "funding_instrument": "Funding Instrument",
    "quantity": "Quantity",
    "uom": "UOM",
    "bid_ref": "Bid Reference No.",
    "bid_notice_status": "Bid Notice Status",
    "award_notice_status": "Award Notice Status",
    "award_title": "Award Title",
    "line_item_no": "Line Item No",
    "item_desc": "Item Description",
    "contract_duration": "Contract Duration",
    "published_date": "Published Date",
    "closing_date": "Closing Date",
    "award_published_date": "Published Date(Award)",
    "proceed_date": "Notice to Proceed Date",
    "effectivity_date": "Contract Effectivity Date",
    "end_date": "Contract End Date",
    "trade_agreement": "Trade Agreement",
    "calendar_type": "Calendar Type",
    "unspsc_code": "UNSPSC Code",
    "unspsc_desc": "UNSPSC Description",
}

# Which columns silver types or cleans, and how.
DATE_COLUMNS = (
    "published_date",
    "closing_date",
    "award_published_date",
    "award_date",
    "proceed_date",
    "effectivity_date",
    "end_date",
)
MONEY_TYPE = "decimal(15,2)"
BLANK_CLEANED = ("agency", "notice_title", "item_name", "item_desc", "award_title", "awardee")
LITERAL_NULL = "NULL"
BUDGET_SENTINEL = -1
DURATION_SENTINEL = "0"

ITEM_TEXT = ("notice_title", "item_name", "item_desc")
CATALOGUE_COLUMNS = ("item_id", *ITEM_TEXT, "unspsc_code", "unspsc_desc")


def to_internal(df: DataFrame) -> DataFrame:
    """Rename published headings to internal names; columns the map does not know keep their name."""
    internal = {heading: name for name, heading in HEADINGS.items()}
    return df.withColumnsRenamed({c: internal[c] for c in df.columns if c in internal})


def to_headings(df: DataFrame) -> DataFrame:
    """Rename internal names to the published headings."""
    return df.withColumnsRenamed({c: HEADINGS[c] for c in df.columns if c in HEADINGS})
