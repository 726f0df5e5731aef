"""Fixed values of the statement domain, in their order of precedence."""

from __future__ import annotations

# --- fixed values: canonical fields and the header texts that name them exactly
FIELDS = ["transaction_date", "description", "debit_amount", "credit_amount", "running_balance"]
AMOUNT_FIELDS = ["debit_amount", "credit_amount", "running_balance"]
HEADER_ALIASES = {
    "transaction_date": ["date", "txn date", "value date", "post date", "trans date", "tran date", "transaction date", "booking date", "doc date", "invoice date", "posting date", "payment date", "billing date", "bill date"],
    "description": ["description", "particulars", "details", "narrative", "transaction details", "remarks", "remark", "memo", "text", "assignment", "reference", "reference key", "document no", "document number", "invoice no", "invoice number", "doc no", "doc number"],
    "debit_amount": ["debit", "withdrawal", "dr", "paid out", "debit amount", "amount dr", "payments"],
    "credit_amount": ["credit", "deposit", "cr", "received", "credit amount", "amount cr", "receipts"],
    "running_balance": ["balance", "running balance", "running bal", "bal", "cumulative balance", "account balance", "cum bal", "cum balance"],
}
# --- fixed values: terms that suggest a field, tried in this order; single words match whole words, phrases anywhere
HEADER_TERMS = {
    "transaction_date": ["transaction date", "doc date", "posting date", "value date", "payment date", "book date", "date", "posting", "txn", "trans", "tran", "value", "booking", "payment"],
    "running_balance": ["closing balance", "running balance", "cum bal", "cum balance", "balance", "outstanding", "bal"],
    "credit_amount": ["credit", "deposit", "cr", "receipt", "received", "refund"],
    "debit_amount": ["debit", "withdrawal", "dr", "payment", "paid"],
    "description": ["description", "particular", "detail", "narrative", "remark", "memo", "text", "assignment", "reference", "invoice", "document", "type", "key", "number", "no", "doc"],
}
# --- fixed values: abbreviations that pair with full words in fuzzy header comparison
HEADER_ABBREVIATIONS = {
    "doc": "document", "ref": "reference", "txn": "transaction", "trans": "transaction", "tran": "transaction", "amt": "amount",
    "bal": "balance", "desc": "description", "particular": "description", "duedate": "date", "postingdate": "date", "docdate": "date",
}
# --- fixed values: dates
NUMERIC_DATE = r"\d{1,2}[/\.-]\d{1,2}[/\.-]\d{2,4}"
ISO_DATE = r"\d{4}[/\.-]\d{1,2}[/\.-]\d{1,2}"
ANCHOR_DATE = rf"(\b{NUMERIC_DATE}\b|\b{ISO_DATE}\b|\b\d{{1,2}}\s+[A-Za-z]{{3,9}}\s+\d{{2,4}}\b|\b[A-Za-z]{{3,9}}\s+\d{{1,2}},?\s+\d{{2,4}}\b)"
ACCEPTED_DATE = rf"^({NUMERIC_DATE}|{ISO_DATE})$"
TEXT_DATE = rf"\b{NUMERIC_DATE}\b|\b{ISO_DATE}\b"
TIME_SUFFIX = r"\s+\d{1,2}:\d{2}(:\d{2})?.*$"
PAGE_DATE_PATTERNS = [r"\b\d{2}[/\.-]\d{2}[/\.-]\d{4}\b", r"\b\d{4}[/\.-]\d{2}[/\.-]\d{2}\b", r"\b\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\b", r"\b\d{2}[A-Za-z]{3}\d{2,4}\b"]
# --- fixed values: page retrieval
QUERY_TERMS = ["opening", "balance", "closing", "transaction", "debit", "credit"]
DATE_HIT = "date_pattern_hit"
# --- fixed values: footers, balances and metadata in the text layer
FOOTER_PHRASES = ["closing balance", "brought forward", "carried forward"]
FOOTER_PAGE = r"\bpage\s+\d+\b"
OPENING_PHRASES = ["opening balance", "balance brought forward", "prev balance", "start balance", "balance b/f"]
CLOSING_PHRASES = ["closing balance", "balance carried forward", "ending balance", "new balance", "balance c/f", "total due", "outstanding", "total outstanding", "ageing analysis total"]
OPENING_TEXT = r"(?i)(?:Opening\s+Balance|Prev\s+Balance|Balance\s+Forward|B/F)\s*[:\-\s]?\s*([0-9\.,\-]+)"
CLOSING_TEXT = r"(?i)(?:Closing\s+Balance|Ending\s+Balance|C/F|Total\s+Due|Total\s+Outstanding|Outstanding\s+Balance|AGEING\s+ANALYSIS\s+TOTAL)\s*[:\-\s]?\s*([0-9\.,\-]+)"
BANKS = ["Chase", "Citi", "Wells Fargo", "HSBC", "Barclays", "Apex Bank"]
ACCOUNT_NUMBER = r"ACC(?:OUNT)?(?:NUMBER|NO|#)?[:\-]?([A-Z0-9-]+)"
UEN = r"(?<!\d)(?:\d{8,9}[A-Z]|[TSR]\d{2}[A-Z]{2}\d{4}[A-Z])(?![A-Z0-9])"
UEN_END = r"[0-9]{4}[A-Z]"  # every UEN has it: a text without one is not searched
CUSTOMER_ID = r"CUST(?:OMER)?ID[:\-]?([A-Z0-9-]+)"
SALESMAN_ID = r"SALESMANID[:\-]?([A-Z0-9-]+)"
TERM_CODE = r"TERMCOD[E]?[:\-]?([A-Z0-9-]+)"
CURRENCIES = {"SGD": ["sgd", "singapore dollar", "s$"], "EUR": ["eur", "euro", "€"], "GBP": ["gbp", "sterling", "£"], "MYR": ["myr", "ringgit"], "USD": ["usd", "us dollar", "us$"]}
# --- fixed values: personal data
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
PHONE = r"\+?\d{1,4}[-\s]\d{1,5}(?:[-\s]\d{3,9})?"
ACCOUNT_TEXT = r"(?i)(Account\s*(?:No|Number|#)?\s*[:\-]?\s*)\b[A-Za-z0-9\-]+\b"
NAMES = r"(?i)\b(?:Chase|Citi|Wells Fargo|HSBC|Barclays|Apex Bank|Aragen|Sigma|Aldrich)\b"
MASKS = {"email": "contact@mockvendor.com", "phone": "+1-555-0199", "account": "ACC-XXXXXX", "name": "Mock-Enterprise"}
MASKED_DESCRIPTIONS = [
    "Invoice Payment #", "Material Procurement Batch #", "Logistics & Shipping Services Fee", "Consultancy Retainer Service", "Equipment Maintenance Lease",
    "Office Supplies Expense", "IT Support Ticket Resolution Fee", "Marketing Campaign Distribution", "Warehouse Storage Space Allocation",
    "Insurance Premium Payment", "Tax Remittance", "Utility Bill Reimbursement", "Vendor Rebate Allocation",
]
SCRUB_ALIASES = {
    "transaction_date": ["date", "txn date", "txndate", "value date", "booking date"],
    "description": ["description", "particulars", "details", "narrative", "remarks", "memo"],
    "debit_amount": ["debit", "withdrawal", "dr", "paid out", "payments"],
    "credit_amount": ["credit", "deposit", "cr", "paid in", "receipts"],
    "running_balance": ["balance", "running balance", "bal", "cumbal", "outstanding"],
}
# --- fixed values: characters that scanners confuse with digits, and sign conventions (credit, debit) in order
CONFUSED, DIGITS = "oOIliSsBgzZ", "00111558922"
CONVENTIONS = [(1, -1), (-1, 1), (1, 1), (-1, -1)]
# --- fixed values: words of a table header in text laid out by position
LAYOUT_KEYWORDS = ["date", "doc", "txn", "type", "po", "debit", "credit", "balance", "amount", "particulars", "description", "ref"]
# --- fixed values: sentences of the audit trail and of the reports
REPAIR_REASON = "OCR confusion repair resolved equations in iteration {}"
NO_HEADER = "No table header identified yet"
NO_DATE = "Row date field invalid or missing (likely footer/summary info)"
MISSING_BOUNDARY = "{} balance boundary extraction failed: using default 0.0"
EMPTY_MISMATCH = "Opening and closing balance mismatch"
CLOSING_MISMATCH = "Closing balance mismatch: expected %.2f, got %.2f"
NOTE_CLEAN, NOTE_REPAIRED, NOTE_ESCALATED = "Clean validation.", "Repaired: ", "Escalated for manual review: balance equation mismatch."
REPAIRED_DETAIL = "Auto-Repaired: '%s' -> '%s' (Reason: %s)"
ESCALATED_DETAIL = "Escalated: Arithmetic validation failed. Handed to review queue."
# --- fixed values: labels of the report workbook, in their order
REPORT_SHEET, AUDIT_SHEET = "Reconciliation Ledger", "Audit Logs & Provenance"
METADATA_LABELS = ["Vendor / Account Owner:", "Account Number Reference:", "Statement Period Range:", "Extraction Confidence Level:", "Triage Verification status:"]
RATE_LABELS = ["Statement Currency:", "Universal Target Currency:", "Applied Exchange Rate:"]
INVARIANT_TITLE = "Arithmetic Invariant Verification Summary"
INVARIANT_LABELS = [
    "Statement Opening Balance:", "Total Credits (Deposits):", "Total Debits (Withdrawals):", "Calculated Statement Ending Balance:", "Reported Statement Ending Balance:",
    "Discrepancy Imbalance (Calculated - Reported):", "Mathematical Equation Check Status:",
]
LEDGER_TITLE, TOTAL_TITLE = "Transaction Ledger", "Ledger Total Summary"
LEDGER_HEADERS = ["Date", "Description / Particulars", "Withdrawals (Dr)", "Deposits (Cr)", "Running Balance", "Validation Status", "Confidence", "Auto-Repair / Escalation Details"]
AUDIT_TITLE, REPAIR_TITLE, UNPARSED_TITLE = "Audit logs & Extraction Anomaly Details", "Auto-Repair Operations", "Unparsed Lines (Action Required)"
REPAIR_HEADERS = ["Field Location", "Raw Extracted Value", "Repaired Value", "Auto-Resolution reasoning", "Confidence"]
UNPARSED_HEADERS = ["Raw Statement Line Text", "Page Number", "Extraction Failure Reason"]
REVIEW_WORDS = ("REVIEW REQUIRED", "CLEAN / RECONCILED")
