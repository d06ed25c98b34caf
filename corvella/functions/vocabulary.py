"""Word lists and patterns whose values results depend on; every function takes its lists as parameters and has these as defaults."""

from __future__ import annotations

# The lists and patterns below must equal the analysed system's for equal results.

STOP_WORDS = tuple(
    """
    about after again against among also been before being between both can could did does doing during each from have having here into itself just more
    most much must only other over same should some such than that their theirs them then there these they this those through under until very were what
    when where which while with within without would your yours study research thesis dissertation ubc university doctoral doctor education
    """.split()
)

LOW_HEADS = tuple(
    """
    higher economic understand understanding experience experiences influenced influence presents presented furthermore year years post types type want
    wants explores examined governed ensures requires played included completed witnessed takes suggests indicates ensuring involving examines discusses
    investigates considers contributes uncovers pervades focuses highlights illustrates argues contends concludes centres centers uses makes tends seems
    leads becomes remains helps needs varies reports think feel know show work move grow view seek face play hold call turn bring give allow recognized
    guided embodied oriented enabled embedded framed situated constructed perceived positioned articulated articulates operationalized operationalizes
    conceptualized conceptualizes problematized analyzed extracted retrieved obtained measured followed collected gathered administered scored tested
    coded rated recorded compiled employed employing implemented reviewed surveyed adopted introduced applied confirmed documented reinforced rejected
    observed distributed undertaken utilized initiated assigned categorized classified recommended strongly beyond around effective affected toward falls
    rises shows gives comes goes runs puts interact exists occurs appears differs leading contributing resulting serving allowing causing producing
    creating forming shaping first second many might will next last once regularly predominantly frequently consistently significantly encountered
    """.split()
)

LOW_ANYWHERE = tuple(
    """
    better furthermore moreover therefore thus however year years different british columbia unspecified rather even although already often particularly
    increasingly differently highly largely generally typically commonly rarely mostly primarily mainly directly closely deeply simply similarly
    essentially effectively actively broadly widely regularly predominantly frequently consistently significantly substantially considerably particular
    reasonably specific certain potentially initially traditionally historically ultimately previously currently recently actually think highlights argues
    contends concludes becomes remains using exploring involving specifically
    """.split()
)

LOW_STARTS = tuple(
    """
    using providing examining exploring applying explaining introducing considering addressing presenting discussing analyzing analysing investigating
    operationalized beyond playing reported reframing perceived focused desired intended centered centred situated reasonably arguably seemingly notably
    broader wider deeper greater lesser further examines discusses identifies analyzed analyzes provided reporting considers former highest lowest overall
    previous existing proposed suggested potential recent creating changing determining strongly inform exercise address engage ensure promote develop
    support enable enhance improve increase reduce prevent identify assess evaluate implement establish maintain achieve facilitate demonstrate understand
    explore examine regularly predominantly frequently consistently significantly substantially considerably encountering maintaining following held
    viewed seen known given drawn taken made found placed based defined shaped formed
    """.split()
)

LOW_TERMS = tuple(
    " ".join(p.split())
    for p in """
    analysis indicated; analyses indicated; conceptual framework; data analysis; data collection; data collected; data indicated; data showed; determine
    whether; findings emerged; findings indicate; findings suggest; focus group; focus groups; high levels; interview data; interview protocol; interview
    protocols; interview schedule; interview transcripts; major findings; make meaning; results indicate; results indicated; results revealed; results
    showed; results suggest; results suggested; semi structured; semi structured interview; semi structured interviews; significant changes; significant
    correlation; significant difference; significant differences; significant effect; significant effects; significant gains; significant interaction;
    significant main; significant main effect; significant positive; significant relationship; significant relationships; significant treatment;
    statistically significant; structured interview; structured interview schedule; structured interview technique; theoretical framework; three themes;
    will help; wide range
    """.split(";")
)

TERM_ANYWHERE = tuple(
    """
    across along cannot carefully conducted creates different diverse emphasized factors feel highlighted impacting including majority methods numerous
    participants potential relative reported respondent respondents subsequent suitable toward towards transcripts whose
    """.split()
)

TERM_HEADS = tuple(
    """
    cannot conducted creates emphasized feel focused highlighted included interviews lead meaning presented presents process reported responses review
    support time transcriptions transcripts whose
    """.split()
)

NUMBER_WORDS = tuple(
    """
    one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty
    hundred
    """.split()
)

CARDINALS = tuple(
    """
    one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty thirty forty fifty hundred
    """.split()
)

PAIR_BLOCKLIST = tuple(
    " ".join(p.split())
    for p in """
    significant differences; statistically significant; significant difference; significant relationships; significant relationship; significantly
    related; control group; treatment groups; treatment group; experimental groups; experimental group; experimental design; randomly assigned; randomly
    selected; random sample; dependent variables; independent variables; dependent variable; independent variable; predictor variables; criterion
    variables; regression analysis; regression analyses; multiple regression; stepwise regression; factor analysis; path analysis; discriminant analysis;
    canonical analysis; analysis variance; multivariate analysis; repeated measures; three groups; two groups; results indicated; results showed; results
    suggest; results revealed; analysis revealed; analysis indicated; analyses indicated; findings indicate; findings indicated; findings suggest; data
    analysis; data collected; data collection; data gathering; data sources; analyzed using; semi structured; interview data; attitudes toward; determine
    whether; based upon; directed towards; further investigation; important factor; wide range; higher levels; high levels; second part; first part; main
    effects; significant main; interaction effects; post test; discriminant function; tennessee self; concept scale; native indian
    """.split(";")
)

NAME_BLOCKLIST = tuple(
    " ".join(p.split())
    for p in """
    _; __; n/a; na; unknown; committee; supervisor; additional supervisory committee members:; additional supervisory committee members; examining
    committee members; examining committee; supervisory committee members; supervisory committee; committee members
    """.split(";")
)
WEAK_HEADS = tuple(
    """
    understanding perspectives perspective experiences experience making sense develop development future current analysis approach framework frameworks
    models model stories story including based used explores examined governed ensures requires played included completed witnessed takes suggests
    indicates ensuring involving reveal reveals revealed supported draws drawn reflect reflects responsible highlights describe describes described
    suggest identified reported found showed presented addressed formed held discuss discussed demonstrates demonstrated achieved selected chosen
    conducted designed established using provided providing relied operationalized similarly explored argue argued argues
    """.split()
)

WEAK_ANYWHERE = tuple(
    """
    purpose deeper better increase making including people participants interviewees transcribed audio taped shared current future used based broad
    complex important necessary well british columbia unspecified rather even although already often particularly significant include resulting related
    general various
    """.split()
)

DISALLOWED = tuple(
    """
    audio taped transcribed shared interviewees participants
    """.split()
)

STRONG_HEADS = tuple(
    """
    education learning policy leadership students student research health curriculum assessment justice knowledge
    """.split()
)

DOMAIN_VARIANTS = (
    ("higher education", ("post-secondary education", "postsecondary education", "tertiary education", "university education")),
    ("doctoral education", ("doctor of education", "edd", "doctoral studies")),
    ("teacher education", ("preservice teacher education", "pre-service teacher education", "initial teacher education")),
    ("educational leadership", ("school leadership", "leadership in education", "education leadership")),
    ("educational policy", ("education policy", "policy in education", "educational policymaking")),
    ("indigenous education", ("first nations education", "aboriginal education", "indigenous pedagogy")),
    ("decolonization", ("decolonisation", "decolonizing", "decolonising")),
    ("equity diversity inclusion", ("edi", "equity, diversity, and inclusion", "diversity equity inclusion")),
    ("inclusive education", ("inclusion in education", "inclusive pedagogy", "inclusive schooling")),
    ("curriculum", ("curriculum development", "curricular design", "curricular")),
    ("assessment", ("student assessment", "learning assessment", "evaluation")),
    ("professional learning", ("professional development", "teacher professional development", "continuing professional learning")),
    ("online learning", ("e-learning", "elearning", "digital learning", "remote learning")),
    ("international students", ("foreign students", "overseas students")),
    ("mental health", ("mental illness", "psychological wellbeing", "psychological well-being")),
    ("british columbia", ("bc", "b.c.", "province of british columbia")),
    ("university of british columbia", ("ubc", "the university of british columbia")),
    ("doctor of education", ("edd", "ed.d.")),
)

METHODOLOGIES = (
    ("Qualitative", r"\bqualitative\b"),
    ("Quantitative", r"\bquantitative\b"),
    ("Mixed Methods", r"\bmixed[- ]methods?\b"),
    ("Case Study", r"\bcase\s+stud(?:y|ies)\b"),
    ("Ethnography", r"\bethnograph(?:y|ic)\b"),
    ("Grounded Theory", r"\bgrounded\s+theory\b"),
    ("Phenomenology", r"\bphenomenolog(?:y|ical)\b"),
    ("Action Research", r"\baction\s+research\b"),
    ("Narrative Inquiry", r"\bnarrative\s+(?:inquiry|research|analysis)\b"),
    ("Survey", r"\bsurveys?\b"),
    ("Experimental", r"\bexperimental\b"),
    ("Longitudinal", r"\blongitudinal\b"),
    ("Content Analysis", r"\bcontent\s+analysis\b"),
    ("Discourse Analysis", r"\bdiscourse\s+analysis\b"),
    ("Document Analysis", r"\bdocument(?:ary)?\s+analysis\b"),
    ("Systematic Review", r"\bsystematic\s+review\b"),
    ("Meta-Analysis", r"\bmeta[- ]analysis\b"),
    ("Thematic Analysis", r"\bthematic\s+analysis\b"),
    ("Historical Research", r"\bhistorical\s+(?:research|analysis|study|method)\b"),
    ("Interviews", r"\binterview(?:s|ing)?\b"),
    ("Autoethnography", r"\bautoethnograph(?:y|ic)\b"),
    ("Participatory", r"\bparticipatory\b"),
)

LOW_TERM_PATTERNS = (
    r"\b(?:results?|findings?|analys(?:is|es)|data)\s+(?:indicat(?:e|ed|es)|show(?:ed|s)?|suggest(?:ed|s)?|reveal(?:ed|s)?|emerg(?:ed|es)?|collected|collection)\b",
    r"\b(?:significant|statistically)\s+(?:difference|differences|relationship|relationships|effect|effects|correlation|interaction|changes?|gains?|positive|treatment|main)\b",
    r"\b(?:interview|interviews|participant|participants?)\s+(?:data|schedule|protocols?|transcripts?|responses?|conducted)\b",
    r"\b(?:theoretical|conceptual)\s+framework\b",
    r"\b(?:determine|investigate|examine|explore)\s+whether\b",
    r"\b(?:first|second|third|fourth|fifth)\s+purpose\b",
    r"\bwill\s+help\b",
)
