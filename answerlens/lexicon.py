"""Keyword lists and markers that results depend on."""

# Sentiment keywords, matched as substrings of the lower-cased context.
POSITIVE_KEYWORDS = (
    "best", "recommend", "recommended", "top choice", "top", "excellent", "ideal",
    "favorite", "favourite", "great", "standout", "highly rated", "leading", "popular",
    "perfect", "robust", "powerful", "user-friendly", "intuitive", "effective",
)
NEGATIVE_KEYWORDS = (
    "avoid", "not ideal", "expensive", "steep", "clunky", "outdated", "complex",
    "lacks", "poor", "drawback", "limited", "hard to use", "frustrating", "confusing",
    "buggy", "overpriced", "slow", "restrictive",
)

# How a failed call tells that the quota of the day is used up.
RATE_LIMIT_MARKERS = ("RESOURCE_EXHAUSTED", "429")
DAILY_MARKERS = ("PerDay", "per_day", "RequestsPerDay", "daily")

# The insight sentences.
INSIGHT_SHARE = (
    "**Brand Visibility Leader**: **%s** leads visibility with a **%s%% mention share** across queried prompts."
)
INSIGHT_POSITION = (
    "**Prime Recommendation Rank**: **%s** earns the highest average placement position (**#%s**), "
    "appearing earliest in generated recommendations."
)
INSIGHT_DOMAIN = (
    "**Dominant Citation Source**: Gemini relies heavily on **%s** (%s citations) "
    "as an authority reference for this niche."
)
INSIGHT_NO_DOMAIN = (
    "**Citation Profile**: Gemini responses primarily rely on parametric memory "
    "without explicit external markdown URL citations."
)
INSIGHT_STAGE = (
    "**Funnel Stage Dynamics**: In the high-intent *Recommendation* stage, "
    "**%s** captures **%s%% share** of voice."
)

# Own wording: the line shown without any mention.
INSIGHT_NOTHING = "No brand mention data available yet. Run the pipeline to generate insights."
