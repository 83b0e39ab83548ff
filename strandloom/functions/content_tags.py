"""Content tags of insurance texts: a rule table, compiled by `rules.all_matches`."""

from __future__ import annotations

from strandloom.functions.rules import Rules

# Tags and their patterns over lower-case text with collapsed white space, in order.
CONTENT_TAGS: Rules = (
    ("Death Benefit", r"death\s*benefit|in\s*case\s*of\s*death|life\s*cover|sum\s*assured\s*on\s*death|risk\s*cover|death\s*claim|nominee|risk\s*commenc|death\s*during"),
    ("Maturity Benefit", r"maturity\s*benefit|on\s*maturity|maturity\s*date|vesting|maturity\s*amount|maturity\s*claim|maturity\s*proceeds|on\s*survival\s*to\s*maturity"),
    ("Survival Benefit", r"survival\s*benefit|money\s*back|periodic\s*payment|survival\s*amount|survival\s*at\s*end|survival\s*percentage|sb\s*payable"),
    ("Guaranteed Additions", r"guaranteed\s*addition|ga\s*@|\bga\b.*per\s*annum|guaranteed\s*income|accrued\s*ga|simple\s*ga|guaranteed\s*benefit"),
    ("Loyalty Addition", r"loyalty\s*addition|la\s*@|\bla\b.*bonus|la\s*at\s*maturity|loyalty\s*bonus|la\s*percentage"),
    ("Bonus", r"bonus|reversionary|simple\s*reversionary|terminal\s*bonus|final\s*additional\s*bonus|fab|interim\s*bonus|accrued\s*bonus|vested\s*bonus|cash\s*bonus"),
    ("Tax Benefit", r"section\s*80|10\s*\(\s*10\s*d\s*\)|tax\s*(?:benefit|exempt|deduction|free)|income\s*tax\s*act|80c|80ccc|80ccd|tax\s*rebate|tax\s*saving|exempt\s*from\s*tax"),
    ("Loan Facility", r"loan\s*(?:facility|against|available)|policy\s*loan|borrow|loan\s*interest|alf|loan\s*eligibility|outstanding\s*loan"),
    ("Surrender", r"surrender\s*value|paid.?up|discontinu|special\s*surrender|gsv|ssv|guaranteed\s*surrender|cash\s*value|exit\s*value|reduced\s*paid.?up|acquired\s*paid.?up"),
    ("Grace Period", r"grace\s*period|revival|lapsed|days\s*grace|reinstatement|revival\s*interest|late\s*payment"),
    ("Premium Waiver", r"premium\s*waiver|waiver\s*of\s*premium|wop|premium\s*exemption|waive\s*future\s*premium"),
    ("Accident Benefit", r"accident(?:al)?\s*(?:death|benefit)|adb|atpd|accidental\s*death|accidental\s*total|accidental\s*permanent|accident\s*rider"),
    ("Critical Illness", r"critical\s*illness|ci\s*benefit|dread\s*disease|ci\s*rider|specified\s*illness|listed\s*illness|new\s*critical\s*illness|linked\s*ci|lci"),
    ("Term Rider", r"term\s*assurance\s*rider|new\s*term|level\s*term|tar|rider\s*sum\s*assured|rider\s*premium"),
    ("Annuity Options", r"annuity\s*option|immediate\s*annuity|deferred\s*annuity|joint\s*life|single\s*life|life\s*annuity|annuity\s*certain|annuity\s*with\s*return|increasing\s*annuity|level\s*annuity|option\s*[a-g]|annuity\s*variant"),
    ("Pension Plan", r"pension|retirement|annuity|vesting\s*benefit|old\s*age|corpus|accumulation\s*phase|payout\s*phase|jeevan\s*(?:akshay|shanti|nidhi|dhara)|saral\s*pension|pm\s*vaya|atal\s*pension"),
    ("Commutation", r"commutation|commuted\s*value|one.?third\s*commutation|lump\s*sum\s*at\s*vesting|partial\s*withdrawal\s*at\s*vesting"),
    ("Deferment", r"deferment\s*period|accumulation\s*period|waiting\s*period|deferred\s*annuity|deferment\s*option|vesting\s*age"),
    ("High Sum Assured", r"high\s*sum\s*assured|hsa\s*rebate|rebate\s*on\s*sum|sum\s*assured\s*discount|large\s*sum\s*assured"),
    ("Limited Pay", r"limited\s*(?:pay|premium)|single\s*premium|one\s*time\s*payment|limited\s*premium\s*paying|5\s*pay|10\s*pay|12\s*pay|15\s*pay"),
    ("Regular Premium", r"regular\s*premium|annual\s*premium|yearly\s*premium|level\s*premium|throughout\s*term"),
    ("Flexible Premium", r"flexible\s*premium|variable\s*premium|top.?up|additional\s*premium|extra\s*premium\s*deposit"),
    ("Regular Income", r"regular\s*income|flexi\s*income|income\s*benefit|periodic\s*income|guaranteed\s*income|monthly\s*income|income\s*plan"),
    ("Whole Life", r"whole\s*life|life\s*long|lifelong\s*cover|till\s*age\s*100|whole\s*of\s*life|entire\s*life"),
    ("Child Plan", r"child\s*(?:plan|policy|education|marriage)|minor|amritbaal|jeevan\s*tarun|children.*benefit|child.*future|education\s*fund|marriage\s*fund|child\s*deferred"),
    ("Endowment", r"endowment|jeevan\s*(?:labh|lakshya|anand|umang)|bima\s*(?:ratna|jyoti|shree)|new\s*endowment|savings\s*plan|money\s*back\s*type"),
    ("Term Insurance", r"term\s*(?:insurance|plan|assurance|cover)|pure\s*protection|risk\s*cover\s*only|tech\s*term|anmol\s*jeevan|jeevan\s*amar|saral\s*jeevan\s*bima|e.?term"),
    ("Money Back", r"money\s*back|survival\s*benefit|periodic\s*return|jeevan\s*(?:shiromani|tarang)|bima\s*(?:bachat|shree)|new\s*money\s*back|survival\s*percentage"),
    ("ULIP", r"ulip|unit\s*linked|market\s*linked|siip|nivesh\s*plus|jeevan\s*(?:umang|profit\s*plus)|fund\s*based|nav\s*based|unit\s*value"),
    ("Fund Options", r"fund\s*option|equity\s*fund|debt\s*fund|balanced\s*fund|bond\s*fund|growth\s*fund|secure\s*fund|money\s*market|liquid\s*fund|index\s*fund"),
    ("NAV", r"\bnav\b|net\s*asset\s*value|unit\s*price|fund\s*value|fund\s*performance|nav\s*date"),
    ("Fund Switch", r"switch|fund\s*switch|switching\s*charge|transfer\s*between\s*funds|reallocation|rebalancing"),
    ("Mortality Charge", r"mortality\s*charge|cost\s*of\s*insurance|coi|risk\s*charge|mortality\s*deduction"),
    ("Fund Management Charge", r"fund\s*management\s*charge|fmc|amc|asset\s*management|management\s*fee"),
    ("Allocation Charge", r"allocation\s*charge|premium\s*allocation|initial\s*allocation|bid.?offer\s*spread"),
    ("Discontinuance Charge", r"discontinuance\s*charge|surrender\s*charge|early\s*exit|exit\s*charge|discontinuation\s*fund"),
    ("Admin Charge", r"admin(?:istration)?\s*charge|policy\s*admin|service\s*charge|maintenance\s*charge"),
    ("Free Look", r"free\s*look|cooling.?off|cancellation\s*period|return\s*policy|15\s*days|30\s*days\s*period"),
    ("Assignment", r"assignment|assignee|absolute\s*assignment|conditional\s*assignment|transfer\s*of\s*policy"),
    ("Nomination", r"nomination|nominee|change\s*of\s*nominee|beneficial\s*nominee|multiple\s*nominee"),
    ("Policy Loan", r"policy\s*loan|loan\s*against\s*policy|auto\s*loan|alf|loan\s*interest"),
    ("Revival", r"revival|reinstatement|revive\s*lapsed|revival\s*period|revival\s*interest|special\s*revival|late\s*revival"),
    ("Paid-up", r"paid.?up\s*(?:policy|value|status)|reduced\s*paid.?up|acquired\s*paid.?up|rpv|auto\s*paid.?up"),
    ("IRDAI", r"irdai|irda|insurance\s*regulatory|regulator|regulatory\s*authority|approved\s*by"),
    ("Section 45", r"section\s*45|non.?disclosure|mis.?statement|contestability|incontestable|repudiation|claim\s*rejection"),
    ("KYC", r"kyc|know\s*your\s*customer|identity\s*proof|address\s*proof|pan\s*card|aadhaar"),
    ("Exclusions", r"exclusion|not\s*cover|suicide|war|riot|hazardous|aviation|pre.?existing|waiting\s*period"),
    ("Claim Process", r"claim\s*(?:process|procedure|settlement)|documents\s*required|claim\s*form|death\s*certificate|proof\s*of\s*(?:death|age)|claim\s*intimation|neft\s*details"),
    ("Claim Settlement Ratio", r"claim\s*settlement\s*ratio|csr|settlement\s*percentage|claim\s*paid"),
    ("Jeevan Utsav", r"jeevan\s*utsav|utsav|plan\s*no\.?\s*871"),
    ("Bima Ratna", r"bima\s*ratna|ratna|plan\s*no\.?\s*863"),
    ("Jeevan Labh", r"jeevan\s*labh|labh|plan\s*no\.?\s*836"),
    ("Saral Pension", r"saral\s*pension|plan\s*no\.?\s*862|simple\s*pension"),
    ("Jeevan Akshay", r"jeevan\s*akshay|akshay|plan\s*no\.?\s*857|immediate\s*annuity"),
    ("Jeevan Shanti", r"jeevan\s*shanti|shanti|plan\s*no\.?\s*850|deferred\s*annuity"),
    ("SIIP", r"\bsiip\b|systematic\s*investment|single\s*premium\s*ulip"),
    ("Nivesh Plus", r"nivesh\s*plus|plan\s*no\.?\s*849|ulip\s*plan"),
)
