"""Fixed word lists and patterns of the measures. All values here are fixed: results depend on them."""

#: Words of the lexical tier: letters, digits and underscores, joined by inner marks.
TOKEN = r"[\p{L}\p{Nd}_]+(?:['’.:·][\p{L}_]+|[,.;'][\p{Nd}]+)*"
#: Sentences of the lexical tier: text up to a run of terminators, within a line.
SENTENCE = r"[^.!?…\n]+[.!?…]*"

#: Characters of each mark; wide and ideographic variants share a name with their narrow counterpart.
MARKS = {
    "comma": ",，、", "semicolon": ";；", "colon": ":：", "period": ".。", "exclaim": "!！", "question": "?？", "em_dash": "—", "en_dash": "–", "hyphen": "-",
    "ellipsis_char": "…", "quote_double_straight": '"', "quote_double_curly": "“”", "quote_single_straight": "'", "quote_single_curly": "‘’", "paren": "()",
    "bracket": "[]", "brace": "{}", "slash": "/", "backslash": "\\", "ampersand": "&", "asterisk": "*", "percent": "%", "hash": "#", "at": "@", "plus": "+",
    "equals": "=", "tilde": "~", "pipe": "|", "caret": "^", "underscore": "_", "nbsp": "\u00a0", "bullet": "•·",
}

MISSING_APOSTROPHE = (
    "dont cant wont isnt arent wasnt werent didnt doesnt hasnt havent hadnt couldnt shouldnt wouldnt im ive youre theyre thats whats lets aint yall "
    "shouldve couldve wouldve"
).split()
MISSPELLINGS = (
    "teh recieve recieved seperate seperated definately occured occurence alot wich adn thier becuase untill wierd arguement accomodate embarass existance "
    "goverment independant neccessary publically recomend refered tommorow truely writting acheive beleive calender "
    "cemetary changable collegue concious enviroment foriegn gaurd harrass immediatly knowlege liason maintainance occassion perseverence priviledge "
    "questionaire rythm succesful supercede threshhold vaccuum visable"
).split()

#: Sentence openers: formulaic ones, then ordinary ones for comparison.
OPENERS = (
    "additionally moreover furthermore however therefore thus consequently notably importantly ultimately overall indeed crucially essentially interestingly "
    "in_conclusion in_summary in_short in_essence in_other_words at_its_core that_said on_the_other_hand as_a_result for_example for_instance firstly secondly "
    "finally i it this there the we you but and so if when while what why"
).split()
MARKERS = (
    "however therefore moreover furthermore additionally nevertheless nonetheless thus hence consequently meanwhile whereas arguably presumably apparently "
    "indeed essentially basically honestly obviously clearly actually frankly notably importantly ultimately crucially specifically particularly fundamentally"
).split()

#: Closed classes of register.
REGISTER = {
    "private_verb_rate": (
        "anticipate assume believe conclude decide demonstrate determine discover doubt estimate fear feel find forget guess hear hope imagine imply indicate "
        "infer know learn mean notice prove realize recall recognize remember reveal see show suppose suspect think understand wish worry assumed believed "
        "concluded decided felt found guessed heard hoped imagined knew known learned meant noticed realized remembered saw seen showed shown supposed "
        "suspected thought understood wished worried believes feels finds knows means notices realizes remembers sees shows supposes suspects thinks understands"
    ),
    "public_verb_rate": (
        "admit admits admitted agree agreed agrees announce announced announces argue argued argues assert asserted claim claimed claims complain complained "
        "concede conceded confess confessed contend contended declare declared declares deny denied denies explain explained explains hint hinted insist "
        "insisted insists mention mentioned mentions object objected predict predicted proclaim proclaimed promise promised promises remark remarked reply "
        "replied report reported reports respond responded say said says state stated states suggest suggested suggests swear swore tell told warn warned "
        "write wrote writes"
    ),
    "suasive_verb_rate": (
        "agree arrange ask beg command commanded commands concede decide decided decides demand demanded demands grant insist insisted instruct instructed "
        "move ordain order ordered orders pledge pledged pronounce propose proposed proposes recommend recommended recommends request requested requests "
        "require required requires stipulate suggest suggested suggests urge urged urges vote voted"
    ),
    "modal:possibility": "can may might could",
    "modal:necessity": "ought should must",
    "modal:prediction": "will would shall 'll 'd",
    "conjunct_rate": (
        "alternatively consequently conversely eg furthermore hence however instead likewise moreover namely nevertheless nonetheless notwithstanding "
        "otherwise rather similarly therefore thus viz accordingly additionally meanwhile subsequently ultimately overall"
    ),
    "amplifier_rate": (
        "absolutely altogether completely enormously entirely extremely fully greatly highly intensely perfectly strongly thoroughly totally utterly very "
        "really incredibly immensely hugely vastly profoundly deeply"
    ),
    "emphatic_rate": "just really most more so such sure surely certainly definitely obviously clearly indeed truly actually literally",
    "downtoner_rate": "almost barely hardly merely mildly nearly only partially partly practically scarcely slightly somewhat sort kind rather quite",
    "discourse_particle_rate": "well now anyway anyhow anyways ok okay right like see look",
    "pron:p1": "i me my mine myself we us our ours ourselves",
    "pron:p2": "you your yours yourself yourselves thee thy thine",
    "pron:p3": "he him his himself she her hers herself they them their theirs themselves",
    "pron:demonstrative": "this that these those",
    "pron:indefinite": "anybody anyone anything everybody everyone everything nobody none nothing nowhere somebody someone something",
    "synthetic_negation_rate": "no neither nor never none nothing nowhere",
}
NOMINAL_SUFFIXES = "tion tions ment ments ness nesses ity ities".split()
NOT_NOMINAL = (
    "nation nations station stations mention mentions question questions motion motions notion notions portion portions ration rations caution cautions "
    "fiction fictions friction auction auctions option options potion potions lotion lotions city cities pity unity entity entities deity deities parity "
    "cavity cavities moment moments comment comments element elements segment segments cement garment garments instrument instruments monument monuments "
    "ornament ornaments regiment regiments sediment witness witnesses business businesses harness wilderness fortnight"
).split()

#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr st mt vs etc eg ie al cf fig no vol pp ed eds approx est inc ltd co corp dept univ assn misc min max avg ca circa e i u a p n".split()
)
#: Substrings that only text copied out of a chat window holds.
RESIDUE = ("oaicite", "contentReference", "turn0search", "turn0news", "navlist", "citeturn", "\ue200", "\ue201", "【")
#: Least number of tokens for low and for good confidence in a family.
FLOORS = {
    "punct": (40, 100), "sentence": (60, 150), "mfw": (500, 2000), "char_ngram": (300, 1000), "richness": (150, 500), "lexicon": (40, 100), "surprisal": (100, 300),
    "rhythm": (200, 800), "contrast": (150, 500), "register": (150, 600), "device": (300, 1200), "syntax": (150, 600), "verse": (200, 800),
}
#: Least denominator of a z-score by unit.
NOISE_FLOORS = {"per_1k": 0.5, "per_100_sentences": 1.0, "per_100_lines": 1.0, "fraction": 0.02, "frequency": 0.002, "tokens": 1.0, "bits": 0.1, "index": 1.0}

#: Forms in -ing that are no verbs.
ING_NOUNS = (
    "thing things king kings ring rings string strings wing wings spring springs ceiling morning evening everything something anything nothing during sibling siblings "
    "shilling willing darling"
).split()
