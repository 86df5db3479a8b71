"""Values that results depend on: lists, tables, texts, formats and patterns."""

from __future__ import annotations

# Fixed values. ---------------------------------------------------------------------------------------

STATE_SHORT = {
    "queensland": "qld",
    "new south wales": "nsw",
    "victoria": "vic",
    "western australia": "wa",
    "south australia": "sa",
    "tasmania": "tas",
    "northern territory": "nt",
    "australian capital territory": "act",
}

STATE_KEYWORDS = {
    "Queensland": ["queensland", "qld"],
    "New South Wales": ["new south wales", "nsw"],
    "Victoria": ["victoria", "vic"],
    "Western Australia": ["western australia", "wa"],
    "South Australia": ["south australia", "sa"],
    "Tasmania": ["tasmania", "tas"],
    "Northern Territory": ["northern territory", "nt"],
    "Australian Capital Territory": ["australian capital territory", "act", "canberra"],
}

CITY_KEYWORDS = {
    "New South Wales": ["sydney", "newcastle", "wollongong", "central coast", "wagga wagga"],
    "Victoria": ["melbourne", "geelong", "ballarat", "bendigo", "warrnambool"],
    "Queensland": ["brisbane", "gold coast", "sunshine coast"],
    "Western Australia": ["perth", "fremantle", "bunbury"],
    "South Australia": ["adelaide", "port augusta", "mount gambier"],
    "Tasmania": ["hobart", "launceston", "devonport"],
    "Northern Territory": ["darwin", "alice springs", "katherine"],
}

DEFAULT_STATE = "Australia"

SETTING_KEYWORDS = {
    "campus": ["campus", "school", "university"],
    "community": ["community", "resident"],
    "aged_care": ["aged care", "nursing"],
}

LOCATION_STOP_WORDS = ["australia", "queensland", "qld", "new", "south", "wales", "nsw", "victoria", "vic"]

LEVEL_COLUMNS = {"SA2": "sa2_name", "SA3": "sa3_name", "SA4": "sa4_name"}

SUPPORT_BANDS = [("high", 20), ("medium", 8)]
OLDER_PEOPLE_LIMIT, NO_CAR_LIMIT = 16, 8

MAP_CENTRE = (134.0, -25.7)

NOTE_OLDER = "Older residents should be considered in smoke, heat, transport, and welfare check planning."
NOTE_NO_CAR = "Transport support and alternative evacuation arrangements should be considered for households without private vehicles."
NOTE_LANGUAGE = "Plain-language and multilingual communication should be considered for warnings, drills, and parent/community updates."
NOTE_LANGUAGE_AREA = "Plain-language and multilingual communication should be considered for warnings, drills, and community updates."
NOTE_TRANSPORT = "Transport vulnerability is not available in the current ABS subset; verify no-car household data from Census/Data by Region before operational use."
NOTE_TRANSPORT_AREA = "Transport vulnerability is not available in the current ABS population layer; verify no-car household data separately."

PRIORITIES = [
    "Confirm official information sources and assign one responsible person to monitor them.",
    "Define evacuation triggers, communication channels, and roll-call responsibilities.",
    "Identify candidate assembly point types and require local approval before treating them as safe.",
    "Prepare first aid, smoke/heat health support, and backup communication arrangements.",
]

CONCERN_PRIORITIES = {
    "Evacuation": "Include clear evacuation routes, decision triggers, and accounting procedures.",
    "Candidate assembly points": "Include candidate assembly point criteria, accessibility, smoke exposure, shade, water, and traffic separation.",
    "First aid training": "Include first aid, AED awareness, burn care, smoke exposure response, and drill records.",
    "Roles and responsibilities": "Use a role table with responsibilities for management, teachers/staff, students, wardens, first aiders, and communications.",
    "Communication channels": "Include primary and backup channels for staff, students, families, and official updates.",
    "Smoke and health risk": "Include smoke exposure controls and support for people with asthma or respiratory conditions.",
    "Road disruption": "Include alternative routes and transport coordination assumptions.",
    "Power / communications outage": "Include offline contact lists, backup power assumptions, and non-internet communication options.",
    "Official information sources": "List official sources and explain when each one should be checked.",
    "Human review and approval": "Include review responsibilities, draft status and approval requirements before operational use.",
}

SETTING_PRIORITIES = {
    "campus": "Keep student supervision, class lists, visitors, and parent/guardian communication explicit.",
    "community": "Include vulnerable residents, transport access, multilingual communication, and neighbour check-ins.",
    "aged_care": "Include resident mobility, medications, clinical governance, and transport provider coordination.",
}

DATA_LIMITATIONS = [
    "The current prototype uses local metadata for official sources and does not read live warning feeds.",
    "Official websites must be checked for current warnings, fire bans, evacuation instructions, and severe weather updates.",
]

GEOGRAPHY_LIMITATIONS = [
    "ASGS allocation files are official geography reference data, not live emergency information.",
    "LGA boundaries and SA2/SA3/SA4 statistical areas may not align cleanly; operational use needs human GIS review.",
]

DEFAULT_RISK_POINT = "Use Australian state or territory emergency services, local council information, and Bureau of Meteorology warnings to verify current risk."
DEFAULT_ASSUMPTION = "No local rule matched this location or scenario yet."

EVIDENCE = [
    ("O1", "Official-source reference", "High source authority, but this report does not confirm currency, completeness or operational applicability.", "Open the official source and verify current information before use."),
    ("P2", "Processed official-origin data", "Moderate and context-dependent; processing, aggregation and geographic matching can introduce limitations.", "Check source year, transformation method, coverage and selected geography."),
    ("R3", "Deterministic rule inference", "Indicative and reproducible, but dependent on configured rules and input matching; it is not observed incident evidence.", "Validate the inference with local officers, plans and current conditions."),
    ("A4", "AI-generated draft synthesis", "Not an evidence source. Model-generated narrative can omit, simplify or invent details.", "A responsible human must verify every operational claim before approval."),
    ("U0", "User-provided / unverified context", "Unverified unless supported by organisational records or an official source.", "Confirm inputs with the responsible organisation."),
]

REQUIRED_SECTIONS = [
    "Executive Summary", "Purpose", "Scope", "Selected Geography", "Data Sources", "Local Risk Context", "Evacuation", "Assembly Point", "Roles",
    "Communication", "First Aid", "Action Plan", "Checklist", "Official", "Evidence Tables", "ASGS", "Safety Disclaimer",
]
OFFICIAL_SOURCE_TERMS = ["Bureau of Meteorology", "BoM", "000", "fire service", "emergency services", "local council", "official", "state emergency"]
DISCLAIMER_TERMS = ["safety disclaimer", "official", "live", "evacuation order"]
ROLE_TERMS = ["roles", "teacher", "student", "first aid", "communication"]
PLACE_TERMS = ["lecture hall", "gymnasium", "library", "sports field", "carpark", "administration building"]
CONFIRMATION_TERMS = ["confirmed safe", "confirmed assembly point", "guaranteed safe"]
EVIDENCE_TABLE_TERMS = ["evidence tables", "selected geography", "community indicators", "official source register"]
EVIDENCE_CONFIDENCE_TERMS = ["evidence confidence and provenance", "o1", "p2", "r3", "a4", "u0"]

NOTICE_MARK, DISCLAIMER_MARK = "**DRAFT STATUS NOTICE**", "Safety disclaimer:"
NOTICE = """**DRAFT STATUS NOTICE**

This report is a preparedness planning draft. It is not emergency advice, does not provide live fire conditions, and does not issue evacuation orders, fire bans or life-safety directions. The responsible organisation must review and approve this draft before formal use. In a life-threatening emergency, call 000.

Safety disclaimer: live warnings, fire bans, evacuation orders and life-safety decisions must come from official emergency services and authorised public information sources.
"""

SIGNOFF_HEADING, EVIDENCE_HEADING = "## Human Review Sign-off", "## Evidence Tables"
SIGNOFF_INTRO = "This section records human review status for pilot governance. It does not convert the report into official emergency advice."
SIGNOFF_FIELDS = [
    ("Review status", "approval_status"), ("Reviewer name", "reviewer_name"), ("Reviewer role", "reviewer_role"), ("Review date", "review_date"),
    ("Organisation / department", "organisation_name"), ("Notes", "review_notes"),
]
SIGNOFF_CHECKS = [
    "- [ ] Official warnings, fire danger information and emergency instructions were checked separately.",
    "- [ ] Candidate assembly points and evacuation routes were reviewed by the responsible organisation.",
    "- [ ] Data sources, limitations and geography assumptions were checked by a human reviewer.",
    "- [ ] O1, P2, R3, A4 and U0 evidence labels were reviewed and supporting claims were verified.",
    "- [ ] This output remains a draft unless the responsible organisation has formally approved it.",
]

MODEL_OUTPUT_PATTERNS = [
    (r"(?is)```json\s*\{.*?```", ""),
    (r"(?i)\b(checklist_update|checklist_complete|plan_complete)\s*\([^)]*\)\s*(has been called)?[.\s]*", ""),
    (r"(?i)Call\s*`?(checklist_update|checklist_complete|plan_complete)`?\s*function.*", ""),
    (r"(?i)`?(checklist_update|checklist_complete|plan_complete)`?", ""),
    (r"https?://\S+", "[verify through the relevant official source]"),
    (r"\n{3,}", "\n\n"),
]

UNKNOWN = "To be confirmed"
DEFAULT_TITLE = "Australian Bushfire Preparedness Report"
DRAFT_STATUS = "Draft - human review required"
REVIEWED_STATUSES = ["Reviewed draft", "Approved by organisation"]
APPROVED_STATUS = "Approved by organisation"
REVIEWER_FIELDS = [("organisation_name", "organisation / department"), ("reviewer_name", "reviewer name"), ("reviewer_role", "reviewer role")]

ERROR_PLACE = "Please enter a location and audience, or load a pilot example."
ERROR_CONCERNS = "Please select at least one focus area, or load a pilot example."
ERROR_REPORT_REVIEW = "Before marking a report as reviewed or approved, please provide: "
ERROR_REVIEW = "Before recording this review status, provide: "
ERROR_CHECKLIST = "Complete every Human Review Checklist item before recording organisational approval."

# End of the fixed values. ----------------------------------------------------------------------------
