"""Vocabularies that results depend on, stated as they are."""

from __future__ import annotations

from typing import NamedTuple

# Tokens that stand for no number, and currency signs.
DASHES = ("-", "–", "—", "−")
NOT_AVAILABLE = ("n/a", "na", "n.a.", "n.a", "not applicable")
NOT_MEANINGFUL = ("nm", "n.m.", "n.m", "not meaningful")
CURRENCIES = "$€£¥"

# Scale words with their factors.
SCALES = {"thousands": 1_000, "millions": 1_000_000, "billions": 1_000_000_000}

# Titles that open a statement, by statement type, in order of precedence.
STATEMENT_TITLES = {
    "BalanceSheet": (
        "balance sheet", "balance sheets",
        "statement of financial position", "statements of financial position",
        "statement of financial condition", "statements of financial condition",
        "statement of assets and liabilities", "statements of assets and liabilities",
    ),
    "IncomeStatement": (
        "income statement", "income statements",
        "statement of income", "statements of income",
        "statement of income (loss)", "statements of income (loss)",
        "statement of operations", "statements of operations",
        "statement of operations and comprehensive income", "statements of operations and comprehensive income",
        "statement of earnings", "statements of earnings",
        "statement of comprehensive income", "statements of comprehensive income",
    ),
    "CashFlowStatement": ("statement of cash flows", "statements of cash flows", "cash flow statement", "cash flow statements"),
    "StockholdersEquityStatement": (
        "statement of equity", "statements of equity",
        "statement of stockholders' equity", "statements of stockholders' equity",
        "statement of shareholders' equity", "statements of shareholders' equity",
        "statement of changes in stockholders' equity", "statements of changes in stockholders' equity",
        "statement of changes in shareholders' equity", "statements of changes in shareholders' equity",
    ),
    "PartnersCapital": (
        "statement of changes in partners' capital", "statements of changes in partners' capital",
        "statement of changes in net assets", "statements of changes in net assets",
        "statement of changes in members' capital", "statements of changes in members' capital",
    ),
    "ScheduleOfInvestments": (
        "schedule of investments", "schedules of investments",
        "schedule of portfolio investments", "schedules of portfolio investments",
        "portfolio of investments",
    ),
}
#: Statements that need a grid of columns: text alone is never parsed into one.
GRID_ONLY = ("StockholdersEquityStatement",)

# Captions that set the context of the rows below them.
SECTION_HINTS = {
    "ASSETS": "ASSET",
    "CURRENT ASSETS": "CURRENT_ASSET",
    "NONCURRENT ASSETS": "NONCURRENT_ASSET",
    "LIABILITIES": "LIABILITY",
    "CURRENT LIABILITIES": "CURRENT_LIABILITY",
    "NONCURRENT LIABILITIES": "NONCURRENT_LIABILITY",
    "LIABILITIES AND EQUITY": "LIABILITY",
    "EQUITY": "EQUITY",
    "STOCKHOLDERS' EQUITY": "EQUITY",
    "SHAREHOLDERS' EQUITY": "EQUITY",
    "NET ASSETS": "EQUITY",
    "NET ASSETS CONSIST OF": "EQUITY",
    "PARTNERS' CAPITAL": "PARTNERS_CAPITAL",
    "OPERATING ACTIVITIES": "OPERATING_ACTIVITY",
    "INVESTING ACTIVITIES": "INVESTING_ACTIVITY",
    "FINANCING ACTIVITIES": "FINANCING_ACTIVITY",
    "REVENUES": "REVENUE",
    "NET SALES": "REVENUE",
    "INVESTMENT INCOME": "REVENUE",
    "INTEREST INCOME": "REVENUE",
    "INTEREST EXPENSE": "INTEREST_EXPENSE",
    "NONINTEREST INCOME": "OTHER_INCOME",
    "NONINTEREST EXPENSES": "OPEX",
    "COST OF SALES": "COGS",
    "OPERATING EXPENSES": "OPEX",
    "EXPENSES": "OPEX",
    "NET REALIZED AND UNREALIZED GAIN (LOSS) ON INVESTMENTS": "INVESTMENT_RESULTS",
    "EARNINGS PER COMMON SHARE": "PER_SHARE",
    "CASH AND CASH EQUIVALENTS": "SUMMARY_CASH_FLOW",
    "SUPPLEMENTAL DISCLOSURE OF NON-CASH FINANCING ACTIVITIES": "SUPPLEMENTAL",
}

# Captions that open a statement where no title came before.
OPENING_CAPTIONS = {
    "ASSETS": "BalanceSheet",
    "CURRENT ASSETS": "BalanceSheet",
    "OPERATING ACTIVITIES": "CashFlowStatement",
    "CASH FLOWS FROM OPERATING ACTIVITIES": "CashFlowStatement",
    "REVENUES": "IncomeStatement",
    "REVENUE": "IncomeStatement",
    "PARTNERS' CAPITAL": "PartnersCapital",
}


class Concept(NamedTuple):
    """A standard concept with the row labels that mean it. contexts: where alone it holds. exact: only a label that equals an alias counts."""

    name: str
    category: str
    subcategory: str
    aliases: tuple[str, ...]
    contexts: tuple[str, ...] = ()
    exact: bool = False


_ASSET_CONTEXTS = ("ASSET", "CURRENT_ASSET", "NONCURRENT_ASSET")
_LIABILITY_CONTEXTS = ("LIABILITY", "CURRENT_LIABILITY", "NONCURRENT_LIABILITY")

# Standard concepts by statement type, in order of precedence (an earlier one wins a tie).
CONCEPTS = {
    "BalanceSheet": (
        Concept("Cash and Cash Equivalents", "Assets", "Current Asset", ("cash and cash equivalents",)),
        Concept("Cash", "Assets", "Current Asset", ("cash",), ("ASSET", "CURRENT_ASSET"), True),
        Concept("Short-Term Investments", "Assets", "Current Asset", ("short-term investments", "short term investments")),
        Concept("Accounts Receivable, Net", "Assets", "Current Asset", ("accounts receivable, net", "accounts receivable", "receivables, net")),
        Concept("Contract Assets", "Assets", "Current Asset", ("contract assets",)),
        Concept("Inventories", "Assets", "Current Asset", ("inventories", "inventory")),
        Concept("Other Current Assets", "Assets", "Current Asset", ("other current assets",)),
        Concept("Total Current Assets", "Assets", "Total Current Assets", ("total current assets",)),
        Concept("Content Assets, Net", "Assets", "Noncurrent Asset", ("content assets, net", "content assets net")),
        Concept("Property, Plant and Equipment, Net", "Assets", "Noncurrent Asset", ("property, plant and equipment, net", "property plant and equipment net", "property and equipment, net")),
        Concept("Goodwill", "Assets", "Noncurrent Asset", ("goodwill",)),
        Concept("Intangible Assets, Net", "Assets", "Noncurrent Asset", ("intangible assets, net", "intangible assets")),
        Concept("Deferred Income Taxes (Assets)", "Assets", "Noncurrent Asset", ("deferred income taxes", "deferred tax assets", "deferred income tax assets"), _ASSET_CONTEXTS),
        Concept("Other Noncurrent Assets", "Assets", "Noncurrent Asset", ("other noncurrent assets", "other long-term assets")),
        Concept("Total Assets", "Assets", "Total Assets", ("total assets",)),
        Concept("Accounts Payable", "Liabilities", "Current Liability", ("accounts payable",)),
        Concept("Current Content Liabilities", "Liabilities", "Current Liability", ("current content liabilities",)),
        Concept("Accrued Expenses and Other Liabilities", "Liabilities", "Current Liability", ("accrued expenses and other liabilities",)),
        Concept("Deferred Revenue", "Liabilities", "Current Liability", ("deferred revenue",)),
        Concept("Short-Term Debt", "Liabilities", "Current Liability", ("short-term debt", "short term debt")),
        Concept("Current Portion of Long-Term Debt", "Liabilities", "Current Liability", ("current portion of long-term debt", "current maturities of long-term debt")),
        Concept("Other Current Liabilities", "Liabilities", "Current Liability", ("other current liabilities",)),
        Concept("Total Current Liabilities", "Liabilities", "Total Current Liabilities", ("total current liabilities", "current liabilities")),
        Concept("Long-Term Debt", "Liabilities", "Noncurrent Liability", ("long-term debt, net", "long-term debt", "long term debt")),
        Concept("Deferred Income Taxes (Liabilities)", "Liabilities", "Noncurrent Liability", ("deferred income taxes", "deferred tax liabilities", "deferred income tax liabilities"), _LIABILITY_CONTEXTS),
        Concept("Noncurrent Content Liabilities", "Liabilities", "Noncurrent Liability", ("non-current content liabilities", "noncurrent content liabilities")),
        Concept("Other Noncurrent Liabilities", "Liabilities", "Noncurrent Liability", ("other noncurrent liabilities", "other non-current liabilities", "other long-term liabilities")),
        Concept("Total Liabilities and Equity", "Summary", "Total Liabilities and Equity", ("total liabilities and equity", "total liabilities and stockholders' equity", "total liabilities and partners' capital")),
        Concept("Total Liabilities", "Liabilities", "Total Liabilities", ("total liabilities",)),
        Concept("Preferred Stock", "Equity", "Equity Item", ("preferred stock",)),
        Concept("Common Stock", "Equity", "Equity Item", ("common stock",)),
        Concept("Treasury Stock", "Equity", "Equity Item", ("treasury stock",)),
        Concept("Accumulated Other Comprehensive Income (Loss)", "Equity", "Equity Item", ("accumulated other comprehensive income", "accumulated other comprehensive income (loss)")),
        Concept("Additional Paid-In Capital", "Equity", "Equity Item", ("additional paid-in capital", "additional paid in capital")),
        Concept("Retained Earnings (Accumulated Deficit)", "Equity", "Equity Item", ("retained earnings", "accumulated deficit")),
        Concept("Total Equity", "Equity", "Total Equity", ("total stockholders' equity", "total shareholders' equity", "total equity", "partners' capital", "net assets")),
        Concept("Investments at Fair Value", "Assets", "Investment Asset", ("investments at fair value", "investment securities at fair value")),
        Concept("Investments at Cost", "Assets", "Investment Asset", ("investments at cost",)),
        Concept("Unfunded Commitments", "Commitments", "Off Balance Sheet", ("unfunded commitments", "unfunded commitment")),
    ),
    "IncomeStatement": (
        Concept("Net Sales", "Revenue", "Revenue", ("net sales",)),
        Concept("Sales", "Revenue", "Revenue", ("sales",), (), True),
        Concept("Revenue", "Revenue", "Revenue", ("revenue", "revenues")),
        Concept("Total Revenues", "Revenue", "Total Revenue", ("total revenues",)),
        Concept("Cost of Revenues", "Cost of Sales", "COGS", ("cost of goods sold", "cost of sales", "cost of revenues")),
        Concept("Gross Profit", "Profit", "Gross Profit", ("gross profit",)),
        Concept("Gross Margin", "Ratio", "Margin", ("gross margin",), (), True),
        Concept("Research and Development Expense", "Operating Expenses", "Opex", ("research and development", "research and development expenses")),
        Concept("Selling, General and Administrative Expense", "Operating Expenses", "Opex", ("selling, general and administrative", "selling general and administrative expenses")),
        Concept("Operating Income (Loss)", "Profit", "Operating Income", ("operating income", "operating loss")),
        Concept("Interest Expense", "Non-Operating", "Expense", ("interest expense",)),
        Concept("Interest Income", "Non-Operating", "Income", ("interest income",)),
        Concept("Income Before Income Taxes", "Profit", "Pre-Tax Income", ("income before income taxes", "earnings before income taxes")),
        Concept("Income Tax Expense", "Taxes", "Tax", ("provision for income taxes", "income tax expense")),
        Concept("Net Income (Loss)", "Profit", "Net Income", ("net income", "net earnings", "net loss")),
        Concept("Net Realized Gain (Loss)", "Investment Results", "Realized Gain Loss", ("net realized gain", "net realized gain (loss)", "realized gain (loss)")),
        Concept("Net Change in Unrealized Appreciation (Depreciation)", "Investment Results", "Unrealized Gain Loss", ("net change in unrealized appreciation", "net change in unrealized appreciation (depreciation)", "change in unrealized appreciation")),
        Concept("Management Fees", "Fund Expenses", "Expense", ("management fees", "management fee")),
        Concept("Carried Interest / Incentive Allocation", "Fund Expenses", "Carry", ("carried interest", "incentive allocation", "performance allocation")),
    ),
    "CashFlowStatement": (
        Concept("Net Income (Loss)", "Operating Activities", "Starting Point", ("net income", "net earnings")),
        Concept("Depreciation and Amortization", "Operating Activities", "Adjustment", ("depreciation and amortization",)),
        Concept("Stock-Based Compensation", "Operating Activities", "Adjustment", ("stock-based compensation", "share-based compensation")),
        Concept("Deferred Income Taxes", "Operating Activities", "Adjustment", ("deferred income taxes",)),
        Concept("Changes in Accounts Receivable", "Operating Activities", "Working Capital", ("accounts receivable",)),
        Concept("Changes in Inventories", "Operating Activities", "Working Capital", ("inventories", "inventory")),
        Concept("Changes in Accounts Payable", "Operating Activities", "Working Capital", ("accounts payable",)),
        Concept("Net Cash Provided by (Used for) Operating Activities", "Operating Activities", "Total Operating", ("net cash provided by operating activities", "net cash used in operating activities", "net cash used for operating activities")),
        Concept("Capital Expenditures", "Investing Activities", "Investing Use", ("capital expenditures", "purchases of property, plant and equipment", "purchases of property and equipment")),
        Concept("Acquisitions, Net of Cash Acquired", "Investing Activities", "Investing Use", ("acquisitions, net of cash acquired",)),
        Concept("Net Cash Provided by (Used for) Investing Activities", "Investing Activities", "Total Investing", ("net cash used for investing activities", "net cash provided by investing activities")),
        Concept("Proceeds from Long-Term Debt", "Financing Activities", "Financing Source", ("proceeds from issuance of long-term debt", "borrowings under long-term debt")),
        Concept("Repayment of Long-Term Debt", "Financing Activities", "Financing Use", ("repayment of long-term debt", "payments of long-term debt")),
        Concept("Dividends / Distributions Paid", "Financing Activities", "Financing Use", ("dividends paid", "distributions paid")),
        Concept("Net Cash Provided by (Used for) Financing Activities", "Financing Activities", "Total Financing", ("net cash used for financing activities", "net cash provided by financing activities")),
        Concept("Net Increase (Decrease) in Cash and Cash Equivalents", "Summary Cash Flow", "Net Change Cash", ("net increase in cash and cash equivalents", "net decrease in cash and cash equivalents", "net change in cash and cash equivalents")),
        Concept("Cash and Cash Equivalents at Beginning of Period", "Summary Cash Flow", "Beginning Cash", ("cash and cash equivalents at beginning of period", "cash at beginning of period", "cash cash equivalents and restricted cash beginning of year", "cash and cash equivalents and restricted cash beginning of year")),
        Concept("Cash and Cash Equivalents at End of Period", "Summary Cash Flow", "Ending Cash", ("cash and cash equivalents at end of period", "cash at end of period", "cash cash equivalents and restricted cash end of year", "cash and cash equivalents and restricted cash end of year")),
        Concept("Capital Contributions", "Financing Activities", "Partner Flow", ("capital contributions", "contributions from partners", "partner contributions")),
        Concept("Distributions to Partners", "Financing Activities", "Partner Flow", ("distributions to partners", "partner distributions")),
    ),
    "PartnersCapital": (
        Concept("Beginning Partners' Capital / Net Assets", "Partners' Capital", "Beginning Balance", ("beginning balance", "partners' capital, beginning", "net assets, beginning")),
        Concept("Capital Contributions", "Partners' Capital", "Contributions", ("capital contributions", "contributions")),
        Concept("Distributions", "Partners' Capital", "Distributions", ("distributions",)),
        Concept("Net Income / Increase in Net Assets from Operations", "Partners' Capital", "Operations", ("net income", "net increase in net assets from operations")),
        Concept("Carried Interest / Incentive Allocation", "Partners' Capital", "Carry", ("carried interest", "incentive allocation")),
        Concept("Ending Partners' Capital / Net Assets", "Partners' Capital", "Ending Balance", ("ending balance", "partners' capital, ending", "net assets, ending")),
    ),
    "ScheduleOfInvestments": (
        Concept("Fair Value", "Investment Schedule", "Valuation", ("fair value",)),
        Concept("Cost", "Investment Schedule", "Valuation", ("cost",)),
        Concept("Principal / Par Amount", "Investment Schedule", "Debt Amount", ("principal amount", "par amount")),
        Concept("Interest Rate", "Investment Schedule", "Debt Terms", ("interest rate", "coupon")),
        Concept("Maturity Date", "Investment Schedule", "Debt Terms", ("maturity", "maturity date")),
    ),
}
#: A label of this form is a concept of its own in these statements: an operating result of a fund is no net income.
FUND_RESULT_PATTERN = r"net (?:increase|decrease|increase \(decrease\)|decrease \(increase\)) in net assets (?:resulting )?from operations"
FUND_RESULT_STATEMENTS = ("IncomeStatement", "CashFlowStatement", "PartnersCapital", "StockholdersEquityStatement")
FUND_RESULT = ("Investment-company change in net assets from operations", "Investment Results", "Period Result", "investment_company_net_increase_from_operations", "period_result")

# What the lines of a page are told apart by, as patterns (Java and Python alike).
_AMOUNT_AT_END = r"(?:[$€£]?\s*\(?[-+]?\d[\d,]*(?:\.\d+)?\)?%?|[—–-])"
PAGE_PATTERNS = {
    "amounts_at_end": rf"(?:\s+{_AMOUNT_AT_END})+\s*$",
    "note_at_end": r"(?i)\s+Note\s+\d+\s*$|\s+(?:\(\d+\))+\s*$",
    "dated_label": r"(?i)years? ended|months? ended|december|january|june|september|march|as of",
    "dated_row": r"(?i)net assets|balance|capital",
    "narrative": r"(?i)\b(?:we|our|the company)\b.*\b(?:was|were|increased|decreased)\b",
    "contents": r"(?i)^(?:table of contents|index to (?:consolidated )?financial statements)$",
    "page_number": r"^(?:\d{1,4}|[—–_.-]+)$",
    "footnote": r"^\(\d+\)\s+\w",
    "no_words": r"^[\d.,()$€£%\s—–-]+$",
    "boundary": r"(?i)^(?:notes? to (?:the )?(?:(?:condensed|consolidated|combined) )*(?:financial statements|financials)|notes? to (?:the )?schedules? of investments|(?:report of |independent ).*(?:auditor|accounting firm)"
    r"|management[’']?s discussion|financial highlights|(?:item\s+\d+[a-z]?\.?\s+)?(?:controls and procedures|signatures)|note\s+\d+[.:\s]|\d+\.\s+(?:organization|significant accounting policies))",
}

# Words that rows of a statement have.
PAGE_CUES = {
    "IncomeStatement": r"income|earnings|revenue|expenses?|profit|loss|per share|weighted.average",
    "BalanceSheet": r"assets?|liabilit|equity|capital|receivable|payable|cash|debt",
    "CashFlowStatement": r"cash|operating activities|investing activities|financing activities|depreciation|supplemental|reinvestment|distributions|PIK|interest paid",
    "PartnersCapital": r"net assets|capital|contributions|distributions|balance|operations",
    "StockholdersEquityStatement": r"equity|shares|capital|balance|earnings|repurchases|dividends",
    "ScheduleOfInvestments": r"fair value|principal|maturity|interest rate|portfolio|investments|cost|\d[.]\d+%",
}

# What a page plan gives as its reasons.
PAGE_EVIDENCE = {
    "titled": "Source heading and statement data",
    "matched": "Matched HTML statement rows and PDF data",
    "confirmed": "; corroborated by matching HTML",
    "more": "Contiguous statement-like table continuation",
    "digits": "Numeric-only continuation lacks labels; review required",
    "unread": "Unreadable page between statement pages; review required",
    "gap": "Conversion gap between statement pages; excluded",
    "boundary": "TOC, notes, auditor or narrative section boundary",
    "notes": "Schedule explanatory footnotes without a statement table",
    "noted": "Schedule explanatory footnotes; retained as section context, not table input",
    "none": "No statement evidence",
    "outside": "; outside the best-supported statement section",
}

# Lines of titles, column heads and page furniture, in lower case.
_DAY = r"(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+(?:19|20)\d{2}"
FURNITURE_LINES = (
    r"years? ended|months ended|quarters? ended|period ended",
    r"^as of |^https?://|sec\.gov/",
    r"^(?:19|20)\d{2}(?:\s+(?:19|20)\d{2}){0,4}$",
    rf"^{_DAY}$",
    r"^(?:\(\s*note\s+\d+\s*\)\s*)+$",
    r"^(?=\D*$)(?=.*fair value)(?=.*(?:cost|net assets))",
    r"\bclass\s+[a-z0-9]+(?:-[a-z0-9]+)*\b.*\bclass\s+[a-z0-9]+",
    r"\bunits\b.*\bunits\b.*total$",
    r"in thousands|in millions|in billions|except per share|unaudited",
)

# Captions beside those of SECTION_HINTS, in capitals.
CAPTION_LINES = (
    r"^PER (?:COMMON )?SHARE DATA$",
    r"^CASH FLOWS FROM (?:OPERATING|INVESTING|FINANCING) ACTIVITIES",
    r"^CASH FLOWS .*ACTIVITIES$",
    r"^LIABILITIES AND (?:STOCKHOLDERS|SHAREHOLDERS|PARTNERS)",
    r"^CHANGES IN OPERATING ASSETS AND LIABILITIES",
    r"^COMMITMENTS AND CONTINGENCIES",
    r"^ADJUSTMENTS TO RECONCILE.*OPERATING ACTIVITIES",
    r"^NET INCOME(?=.*PER COMMON SHARE).*SHAREHOLDER",
    r"^TOTAL WEIGHTED AVERAGE COMMON SHARES.*OUTSTANDING",
)

# Lines at the top of a statement that are no company's name, in lower case.
NO_COMPANY_LINES = (
    r"^$|^table of contents$|sec\.gov/|^https?://",
    r"^part\s+[ivx]+\.?\s+financial information$|^item\s+\d+[a-z]?\.?\s+financial statements$",
    r"^\d{1,2}/\d{1,2}/\d{2,4}(?:,?\s+\d{1,2}:\d{2}\s+[ap]m)?\s+form\s+10-[kq]$",
    r"in (?:millions|thousands|billions)",
)

# What a row of amounts alone totals, by context: the group it closes, its labels in turn, whether the last label comes again, the context after it.
UNLABELLED_TOTALS = {
    "CURRENT_ASSET": ("current assets", ("Total current assets",), True, "ASSET"),
    "CURRENT_LIABILITY": ("current liabilities", ("Total current liabilities",), True, "LIABILITY"),
    "ASSET": ("assets", ("Total assets",), False, "ASSET"),
    "NONCURRENT_ASSET": ("assets", ("Total assets",), False, "ASSET"),
    "LIABILITY": ("liabilities", ("Total liabilities",), False, "LIABILITY"),
    "NONCURRENT_LIABILITY": ("liabilities", ("Total liabilities",), False, "LIABILITY"),
    "EQUITY": ("equity", ("Total stockholders' equity", "Total liabilities and stockholders' equity"), False, "EQUITY"),
}
