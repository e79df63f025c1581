"""Word lists, patterns and constants of the cleaning profiles. Results depend on them as they stand."""

# White space and line breaks as Python's str methods see them, for Java and RE2 alike.
WS = r"[\t-\r\x1c-\x20\x85\pZ]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Line shapes: [..] user: text, and user: text.
BRACKET_LINE = rf"(?s)^\[[^\]]*\]{WS}*([^:]+):{WS}*(.*)$"
PLAIN_LINE = rf"(?s)^{WS}*([^:]+):{WS}*(.*)$"
SPACED_BRACKET_LINE = rf"(?s)^\[[^\]]+\]{WS}+[^:]+:{WS}*(.*)$"
URL, URL_CASED, MENTION = r"(?i)https?://[^\t-\r\x1c-\x20\x85\pZ]+", r"https?://[^\t-\r\x1c-\x20\x85\pZ]+", r"@[\pL\pN_]+"
BADGE = rf"(?i)(?:[0-9]+{WS}*-{WS}*year{WS}*subscriber{WS}*)?moments{WS}+badge{WS}*-{WS}*tier{WS}*[0-9]+{WS}*"

# Distill profile
DISTILL_BOTS = ("nightbot", "streamelements", "moobot", "streamlabs", "fossabot", "wizebot", "deepbot")
DISTILL_SYSTEM = rf"\b(?:subscribed(?:{WS}+at{WS}+tier)?|subscribed{WS}+with{WS}+prime|resubscribed|gift(?:ed|ing)|watch streak|consecutive streams|first time chatter|community sub|prime gaming|cheer(?:ed|ing)?)\b"

# Moment profile
MOMENT_SYSTEM = ("subscribed at tier", "subscribed with prime", "gifted", "watch streak", "consecutive streams", "they've subscribed", "has subscribed", "resubscribed", "month streak", "first time chatter", "community sub", "is gifting", "prime gaming", "sparked a watch streak")
MOMENT_STOPWORDS = (
    "a about after all an and any are as at be been being bro but by can could chat do dude for from get getting go going good guy guys had has have he her here him his how i if im in into is it its just like lol "
    "look looks lmao me moment my no not now of oh on one or our out people pls please really right so some someone something still stream stuff t that the their them there they thing this tho to too u up ur was we "
    "what when where who why with would yeah you your"
).split()
MOMENT_NOISE = "awoo clap cmonbruh derp emote fr gg glorp glorpsi huh icant kekw kkonaw lolll lul monkas omegalul oop pearto pog poggers saj xdd xd ww".split()
SHORT_OK = ("gta", "nba", "osu", "cod", "cs2", "lcs", "wow", "tf2")
TONES = {
    "laughter": r"\b(?:lol|lmao|lmfao|lul|omegalul|kekw|haha+|hehe+|xd+)\b",
    "hype": rf"\b(?:let'?s{WS}*go+|letsgo+|pog+|hype|gooo+|we up|we are so back|w\b)\b",
    "approval": r"\b(?:good|nice|great|love|based|fire|clean|solid|awesome|valid|goated|cute)\b",
    "confusion": r"\b(?:what|wtf|huh|why|how|wait|confused|unclear|hello)\b",
    "frustration": r"\b(?:bad|trash|awful|hate|boring|annoying|stupid|worst|lame|mid|sucks?|terrible|painful|bullshit)\b",
    "mockery": r"\b(?:clown|bozo|cooked|washed|cringe|fraud|deadass|skill issue|roast|joke|funny)\b",
}
QUESTION_WEIGHT, MOCKERY_WEIGHT = 0.35, 0.65
CONCEPTS = {
    "fall guys": r"\bfall guys\b",
    "ocean man": r"\bocean man\b",
    "new vegas": r"\bnew vegas\b",
    "roblox": r"\broblox\b",
    "bart": r"\bbart\b",
    "neon": r"\bneon\b",
    "christmas tree": r"\bchristmas tree\b",
    "kitty": r"\b(?:kitty|cat)\b",
    "bazooka": r"\bbazooka\b",
    "bullshit": r"\bbull ?shit\b",
    "clown car": r"\bclown car\b",
    "throop": r"\bthroop\b|\bthroughp\b",
    "office": r"\bthe office\b|\bscranton\b",
    "geography": r"\bgeoguessr\b|\bromania\b|\bbulgaria\b|\bturkey\b|\bturkiye\b|\bbalkans\b|\beast\b",
    "driving": r"\bdriv\w*\b|\bsteering wheel\b|\bgas pedal\b|\bturning\b|\bboost\b|\bcar\b",
    "gibberish": r"\bglue\b|\bcereal\b|\bmarf\w*\b|\bjaming\b|\bmonoxide check\b|\bfruit farming\b",
    "vibes": r"\bvibes?\b|\btoxic\b|\brancid\b",
    "slur alert": r"\balert\b.*\bslur\b|\bslur\b.*\balert\b|\bone slur\b",
    "spoilers": r"\bleak\w*\b|\bspoiler\w*\b",
    "copypasta": r"\bcopy ?pasta\b|\bspam\b",
    "goodnight": r"\bgoodnight\b|\bnightnight\b|\bbye\b|\blove you\b",
    "list": r"\blist\b|\branking\b|\bhonorable mentions?\b|\bwhat about\b",
    "bah bah": r"\bbah\b",
    "heavy": r"\bheavy\b",
}
DEATH_WORDS = ("dead", "died", "dies", "kill", "killed", "shot", "rip", "o7", "execute", "murdered")
ARGUMENT_WORDS = ("liar", "lying", "cap", "fraud", "accountability", "story", "both sides", "arguing")
TEAMPLAY_WORDS = ("teammate", "comms", "baiting", "throw", "self promo", "modz")
LOOK_WORDS = ("look", "looks", "cute", "ugly", "weird", "fish", "chopped", "derpy")
# Tokens that name no person, and how often a person has to be named.
NO_PERSONS, PERSON_LEAST = ("alert", "bullshit", "kitty", "throop", "glue"), 4
CALL_PATTERN, GENERIC_CALL_NAMES = rf"\bcall{WS}+([A-Za-z][A-Za-z0-9_']+)\b", ("someone", "somebody", "him", "her", "them", "bro", "guy", "girl", "chat")
# Topic by concept counts, first match wins: ((concept, least count), ...), topic, kind; "{call}" is the name called most.
TOPIC_RULES = (
    ((("kitty", 2), ("christmas tree", 2)), "the cat and Christmas tree bit", "bit"),
    ((("kitty", 3),), "the cat", "entity"),
    ((("christmas tree", 2),), "the Christmas tree", "entity"),
    ((("bullshit", 5),), "the BULLSHIT chant", "bit"),
    ((("clown car", 1),), "the clown-car visual", "bit"),
    ((("slur alert", 1),), "the ALERT slur joke", "bit"),
    ((("vibes", 2),), "how rancid the vibes are", "mood"),
    ((("throop", 3),), "the Throop town-name riff", "bit"),
    ((("office", 2), ("throop", 1)), "the Scranton and Office jokes", "bit"),
    ((("geography", 3),), "the geography guess", "event"),
    ((("gibberish", 3),), "the weird gibberish bit", "bit"),
    ((("list", 2),), "the game list", "event"),
    ((("goodnight", 6),), "the stream ending", "event"),
    ((("spoilers", 3),), "the spoilers", "event"),
    ((("driving", 4),), "the driving", "event"),
    ((("death", 4), ("bazooka", 1)), "the bazooka kill", "event"),
    ((("death", 5),), "someone getting killed", "event"),
    ((("call", 2),), "the call with {call}", "event"),
    ((("teamplay", 2),), "the bad teamplay", "event"),
    ((("argument", 2),), "the argument", "event"),
)
HOST_NAMES = r"\b(?:caseoh|casey|jerma985?|jerma|northernlion|nl|squeex|jasontheween|jason|vinesauce|vinny)\b"
ALIASES = {
    "caseoh.json": ("caseoh", "casey", "case", "caso"),
    "jerma1.json": ("jerma", "jerma985"),
    "northernlion1.json": ("northernlion", "nl", "ryan"),
    "northernlion2.json": ("northernlion", "nl", "ryan"),
    "squeex.json": ("squeex",),
    "jasontheween.json": ("jason", "jasontheween", "theween"),
    "vinesauce.json": ("vinesauce", "vinny", "vine"),
}

# Prep profile
PREP_BOTS = (
    rf"\bsubscribed\b|\bsubscription\b|\bgift(?:ed)?{WS}*sub(?:scription)?s?\b|\b[0-9]+{WS}*gift{WS}*sub(?:scription)?s?\b|\braid(?:ed)?\b|\bcheer{WS}*[0-9]+\b|\bprime{WS}+gaming\b|\bprime{WS}+sub\b|\b[0-9]+[- ]?month(?:s)?\b"
    r"|\bwelcome to the chat room\b"
)
PREP_NOISE_LINE = rf"^![\pL\pN_]+|^@[\pL\pN_]+{WS}*->"
PREP_METADATA = rf"\b[0-9]{{1,2}}{WS}?[ap]m\b|subscriber|turbo|prime|gift|cheer|badge|recap|runner"
PREP_NOISE_PREFIXES = ("caseoh", "jynxzi", "twitchcon", "robloxcheer", "goldplz", "subprise", "dailydoodle", "thorfork", "kittyyy", "kappu", "dinodance", "powerup", "squid", "pogchamp", "kekw", "lul", "omegalul")
PREP_NOISE_EXACT = "kappa pog lul lol lmao kekw ww www w l fr bro yo case caseoh chat stream live hello hiii hi hey pls please".split()
PREP_STOPWORDS = (
    "the and for that with this from were was are you your chat about what when where they them have just like dont don't its it's had out into then than there here play showed reaction response messages around activity watch today "
    "tonight really very"
).split()
PREP_SENTIMENT = {
    "laughter": "lol lmao rofl omegalul kek lmfao lul haha hahaha".split(),
    "confusion": "what huh why confused wtf idk how".split(),
    "positive": "w goat fire peak based good great love pog nice".split(),
    "negative": "l trash bad mid awful boring hate terrible".split(),
}
NO_TOPIC = "the ongoing discussion"
SENTIMENTS = ("laughter", "confusion", "approval", "disapproval", "mixed")
# Our own wording: {topic} and {sentiment} are filled in.
LEADS = (
    "Around {topic}, chat leaned toward {sentiment}.",
    "With {topic} on screen the mood was {sentiment}.",
    "{topic} set off {sentiment} among viewers.",
    "Viewers met {topic} with {sentiment}.",
    "Talk of {topic} carried {sentiment}.",
    "The lines on {topic} read as {sentiment}.",
)
REASONS = {
    "approval": "show that most were behind it",
    "disapproval": "show that most were against it",
    "confusion": "show that few knew what was going on",
    "laughter": "show that it was taken as a joke",
    "mixed": "show that opinions went both ways",
}

# Retrieval profile
RETRIEVAL_STOPWORDS = "a an and are as at be but by for from has he in is it its of on or that the to was were will with you your we they this those these i me my our".split()
EMOTIONS = {
    "hype": "pog poggers letsgo letsg let's hype insane holy w w+ clutch".split(),
    "laughter": "lol lmao lmfao lul lulw omegalul xd rofl haha".split(),
    "frustration": "wtf bruh sadge trash bad throw choke rigged".split(),
    "surprise": "no way what crazy actually omg".split(),
}
EMOTION_SENTIMENT = {"laughter": "laughter", "hype": "hype", "frustration": "disapproval", "surprise": "confusion", "reaction": "hype"}
INTERPRETATIONS = {"laughter": "everyone in on the same joke", "hype": "a burst of excitement", "disapproval": "open pushback", "confusion": "doubt over what had happened"}

# Corpus profile
LOW_INFO = rf"\bother things\b|\bwatching some goofball\b|\btopic(?:{WS}+is)?{WS}+unclear\b"
