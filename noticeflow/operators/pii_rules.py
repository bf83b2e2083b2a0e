"""Personal-data rules as data: patterns, labels, priorities and gates.

Every rule is ``before`` + ``value`` + ``after``; only ``value`` is masked.  Order in ``RULES`` is the tie-break
between detections of equal priority and length.
"""
from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: word lists, patterns and labels that decide the result -------------------------------------

# label -> token prefix
PREFIXES = {
    "person": "이름", "phone": "전화", "email": "이메일", "address": "주소", "id": "주민번호",
    "document_id": "문서번호", "ip": "IP", "secret": "비밀값", "birth": "생년월일",
    "klass": "반", "student_number": "학번", "url": "개인링크",
    "account": "계좌", "handle": "계정",
}

# label of a token-classification model -> label here
MODEL_LABELS = {
    "private_person": "person", "private_address": "address", "private_phone": "phone", "phone_number": "phone",
    "private_email": "email", "account_number": "account", "resident_id": "id", "document_id": "document_id",
    "ip": "ip", "ip_address": "ip", "private_secret": "secret", "secret": "secret", "birth_date": "birth",
    "private_class": "klass", "private_student_number": "student_number", "private_url": "url",
    "postal_code": "address", "private_date": "birth", "personal_handle": "handle",
}

# one- and two-syllable family names
SURNAMES_1 = (
    "김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변"
    "염추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용봉사피갈감태빙단야궉평"
)
SURNAMES_2 = ("남궁", "제갈", "황보", "사공", "선우", "서문", "독고", "동방", "어금", "강전", "망절")

# ---- fixed values: words found where a name could stand that are never a name
NOT_A_PERSON = (
    "담임", "담당", "수련", "지도사", "선생", "선생님", "교직원", "예방교육", "학년부", "교무부", "학생부", "행정실", "교육청", "관리자", "전체", "여러분",
    "각반", "각학년", "안내", "요청", "회의", "부장님", "학부모", "보호자", "학년", "모든", "전교", "해당", "관련", "각각", "신규", "기간제", "전담",
    "보건", "영양", "사서", "상담", "체육", "음악", "미술", "영어", "수학", "국어", "과학", "사회", "역사", "도덕", "기술", "가정", "정보", "한문",
    "일본어", "중국어", "진로", "특수", "유치원", "초등", "중등", "고등", "교과", "부담임", "학급", "교무", "연구", "생활", "안전", "인성", "방과후",
    "돌봄", "급식", "시설", "교육", "행정", "감사", "존경하는", "친애하는", "연락처", "전화", "전화번호", "휴대폰", "핸드폰", "문의", "문의처", "이메일",
    "메일", "번호", "대표", "사무실", "긴급", "비상", "내선", "직통", "팩스", "주소", "우리", "저희", "해당반", "우리반", "전교생", "재학생", "연수",
    "명단", "명부", "성적", "지도", "방문", "인원", "임원", "전원", "유의", "배정", "신청", "봉사", "조회", "제출", "서류", "회신", "문서", "공지",
    "안건", "심의", "표준", "기간", "기준", "고지", "국내", "선발", "선정", "선착순", "설문", "도서", "권한", "감염", "예방", "예정", "오전",
    "오후", "전달", "참가", "차량", "하교", "등교", "방학", "학사", "임시", "정기", "추가", "확인", "제한", "최종", "우수", "구분",
)
NOT_IN_A_NAME = ("선생", "학생", "교사", "학년", "담당", "부장", "교감", "교장", "학교", "교육", "부서", "여러분")
NAME_PARTICLE = r"(?:께서|님께|님|께|씨|이|가|은|는|의|과|와|도|에게|한테)$"

SEP = r"[\-.\s_]"
NO_DIGIT_BEFORE = r"(?<![\d\-._])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NOT_WORD_BEFORE, NOT_WORD_AFTER = r"(?<![\w-])", r"(?![\w-])"
DASH = r"\s*[-–]\s*"
ROLE = r"(?:선생님|선생|주무관|선임|부장|교감|교장|담임|교사|주임|과장|팀장|원장|실장|쌤|샘|학생|군|양)"
LEADING_ROLE = (r"(?:수련지도사|담임|학생|보호자|학부모|선생님|선생|교사|교감|교장|부장|주무관|선임|주임|과장|팀장|원장|실장"
                r"|강사)")
REGION = (r"(?:서울(?:특별시|시)?|경기도|인천(?:광역시)?|부산(?:광역시)?|대구(?:광역시)?|대전(?:광역시)?|광주(?:광역시)?"
          r"|울산(?:광역시)?|세종(?:특별자치시)?|강원(?:특별자치도)?|충청[남북]도|전라[남북]도|경상[남북]도"
          r"|제주(?:특별자치도)?)")

# shortest literals that every match of the pattern beside them holds
SECRET_HINTS = ("비밀번호", "암호", "패스워드", "인증번호", "키", "토큰", "OTP", "otp", "Otp", "oTP", "OtP", "OTp", "otP", "oTp")
ROLE_HINTS = ("선생", "주무관", "선임", "부장", "교감", "교장", "담임", "교사", "주임", "과장", "팀장", "원장", "실장", "쌤", "샘",
              "학생", "군", "양")
LEADING_ROLE_HINTS = ("지도사", "담임", "학생", "보호자", "학부모", "선생", "교사", "교감", "교장", "부장", "주무관", "선임",
                      "주임", "과장", "팀장", "원장", "실장", "강사")
REGION_HINTS = ("서울", "경기도", "인천", "부산", "대구", "대전", "광주", "울산", "세종", "강원", "충청", "전라", "경상", "제주")

# contexts looked for around a candidate
POSITIVE = ("학생|학생회|학부모|보호자|출석|결석|명단|명렬|학급|반별|담임|상담|수상|시상|대상자|전입|전학|학적|성명|이름|번호"
            "|사진|파일|좌석")
STRONG = "학생|학생증|명단|명렬|출석|결석|담임|학번|학생번호|성명|이름|전입|전학|학적|좌석"
COMPACT_NEGATIVE = ("교시|시간표|수업|쪽|페이지|단계|주차|개월|주간|일간|버전|번지|문제|문항|기간|날짜|연도|학기|비율|시작|종료"
                    "|(?<![가-힣])(?:명|건|원|점|호)(?![가-힣])")
NUMBER_NEGATIVE = "문제|문항|페이지|쪽|회차|번째|차시|번지|단계|교시|시간|(?<![가-힣])(?:호|명|건|원|점)(?![가-힣])"
WINDOW = 34

DATE_WITH_HOUR = r"20\d{2}-\d{2}-\d{2}(?:[ T]?\d{1,2})?"
BIRTH_HINT = "생년월일|출생|생일|태어난"
BIRTH_BEFORE = r"(?:생년월일|출생일|생일)\s*[:=：]?\s*"
BIRTH_VALUE = r"\d{2,4}[./-]\d{1,2}[./-]\d{1,2}|\d{6,8}"
PRIVATE_URL = (r"(?:token|auth|key|password|invite|signature)=|docs\.google\.com|drive\.google\.com|forms\.gle"
               r"|open\.kakao")
ID_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)

ROSTER_HEADER = r"학번\s*[\r\n ]+이름\s*[\r\n ]+전화번호"
ROSTER_VALUES = (r"\d{5}", r"[가-힣]{2,4}", r"\d{3,4}[ ._-]?\d{4}|01[016789][ ._-]?\d{3,4}[ ._-]?\d{4}")
ROSTER_PARTS = (("student_number", "roster_id"), ("person", "roster_name"), ("phone", "roster_phone"))

# span ends a model tends to include
TRIM_CHARS = " .,\t\n()[]"
TRAILING_PARTICLES = (
    "이에요", "이라고", "입니다", "이야", "이랑", "한테", "에게", "으로", "이가", "이는", "에서", "이고", "예요", "씨", "님",
    "이", "가", "은", "는", "을", "를", "야", "아", "에", "의", "랑", "께", "고",
)


# ---- rules -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    value: str
    before: str = ""
    after: str = ""
    prio: int = 4
    gate: str = ""          # see pii_detect.GATES
    flags: str = ""
    # necessary conditions on the text, checked before the regex runs (byte search is far cheaper than a regex scan)
    hangul: bool = False            # holds a Hangul syllable
    digits: int = 0                 # holds a run of this many digits (0, 1 or 4)
    any_of: tuple[str, ...] = ()    # holds one of these literals

    @property
    def pattern(self) -> str:
        return f"({self.before})({self.value})({self.after})"


# ---- fixed values: the patterns of the rules below
STRUCTURED = (
    Rule("document_code", "document_id", r"[A-Za-z]{1,2}\d{8,10}", r"(?<![A-Za-z0-9])", r"(?![0-9])",
         gate="not_date_hour", digits=4),
    Rule("neis_id", "document_id", r"[A-Z]\d{9}", r"(?<![A-Za-z0-9])", r"(?![0-9])", gate="not_date_hour", digits=4),
    Rule("licence_like", "document_id", r"[A-Z]{2}-[A-Z]{3}-\d{4}", r"(?<![A-Za-z0-9])", r"(?![0-9])",
         gate="not_date_hour", digits=4, any_of=("-",)),
    Rule("mobile", "phone", rf"01[016789]{SEP}?\d{{3,4}}{SEP}?\d{{4}}", NO_DIGIT_BEFORE, r"(?!\d)",
         digits=1, any_of=("01",)),
    Rule("landline", "phone", rf"0(?:2|[3-6][1-5]){SEP}?\d{{3,4}}{SEP}?\d{{4}}", NO_DIGIT_BEFORE, r"(?!\d)",
         digits=4, any_of=("0",)),
    Rule("local_phone", "phone", rf"\d{{3,4}}{SEP}\d{{4}}", NO_DIGIT_BEFORE, r"(?!\d)", digits=4),
    Rule("email", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?<![A-Za-z0-9._%+-])",
         any_of=("@",)),
    Rule("ipv4", "ip", rf"(?:{OCTET}\.){{3}}{OCTET}", r"(?<![\d.])", r"(?![\d.])", digits=1, any_of=(".",)),
    Rule("rrn", "id", r"\d{6}-[1-4]\d{6}", r"(?<!\d)", r"(?!\d)", prio=5, gate="id_checksum",
         digits=4, any_of=("-",)),
)
CLASS_NUMBERS = (
    Rule("triple", "student_number", rf"[1-6]{DASH}\d{{1,2}}{DASH}\d{{1,3}}", NOT_WORD_BEFORE, NOT_WORD_AFTER,
         digits=1, any_of=("-", "–")),
    Rule("grade_class", "klass", r"\d{1,2}\s*반", r"(?<!\d)\d{1,2}\s*학년\s*", r"(?![\d급])",
         hangul=True, digits=1, any_of=("학년",)),
    Rule("compact_class", "klass", rf"[1-6]{DASH}\d{{1,2}}\s*반", NOT_WORD_BEFORE, r"(?![\w급-])",
         hangul=True, digits=1, any_of=("반",)),
    Rule("explicit_number", "student_number", r"\d{1,10}(?:\s*번)?",
         r"(?:학번|학생번호|출석번호|개인번호|학생\s*번호)\s*[:：]?\s*", hangul=True, digits=1, any_of=("학번", "번호")),
    Rule("number_unit", "student_number", r"\d{1,3}\s*번", r"(?<!\d)", r"(?![호째지])", gate="number_context",
         hangul=True, digits=1, any_of=("번",)),
    Rule("compact", "klass", rf"[1-6]{DASH}\d{{1,2}}", NOT_WORD_BEFORE, NOT_WORD_AFTER, gate="compact_context",
         hangul=True, digits=1, any_of=("-", "–")),
    Rule("five_digit", "student_number", r"[1-6]\d{4}", r"(?<!\d)", r"(?!\d)", gate="strong_context",
         hangul=True, digits=4),
)
CONTEXTUAL = (
    Rule("secret", "secret", r"[^\s,;]{4,80}", r"(?:비밀번호|암호|패스워드|인증번호|OTP|API\s*키|토큰)\s*[:=：]?\s*", flags="iu",
         any_of=SECRET_HINTS),
    Rule("birth", "birth", BIRTH_VALUE, BIRTH_BEFORE, hangul=True, digits=1, any_of=("생년월일", "출생일", "생일")),
    Rule("labeled_id", "document_id", r"[A-Za-z0-9][A-Za-z0-9_-]{3,39}",
         r"(?:신청번호|접수번호|사번|학번|학생번호)\s*[:：]?\s*", hangul=True, any_of=("번호", "사번", "학번")),
    Rule("address_line", "address", REGION + r"[^\r\n]{4,100}?\d+(?:-\d+)?(?:\s*\([^\r\n)]{1,30}\))?",
         hangul=True, digits=1, any_of=REGION_HINTS),
    Rule("private_url", "url", r"https?://[^\s<>'\"]+", gate="private_url", any_of=("://",)),
    Rule("name_before_role", "person", r"[가-힣]{2,4}", r"(?<![가-힣])",
         rf"(?=\s*{ROLE}{{1,3}}(?:께서|님께|님|께|씨|이|은|는|의|과|와|도|에게|한테)?(?![가-힣]))",
         prio=3, gate="family_name", hangul=True, any_of=ROLE_HINTS),
    Rule("name_after_role", "person", r"[가-힣]{2,4}", rf"(?:^|[\s(\[·,，、])(?:{LEADING_ROLE})(?:님)?\s*",
         r"(?![가-힣])", prio=3, gate="family_name", flags="m", hangul=True, any_of=LEADING_ROLE_HINTS),
    Rule("name_before_contact", "person", r"[가-힣]{2,4}", r"(?<![가-힣])",
         r"(?=\s*(?:01[016789]|0\d{1,2}[-.)]|[A-Za-z0-9._%+-]+@))", prio=3, gate="family_name", hangul=True),
    Rule("labeled_name", "person", r"[가-힣]{2,4}",
         r"(?:수련지도사|담당자|담당|강사|성명|이름|학생|보호자|학부모|보낸\s*사람|발신자?)[^:\n]{0,18}[:：]\s*\(?\s*",
         r"(?=\s*(?:☎|\d|/|,|\)|\(|$|\s))", prio=3, gate="name", hangul=True, any_of=(":", "：")),
    Rule("self_name", "person", r"[가-힣]{2,4}", r"저\(", r"\)", prio=3, gate="name", hangul=True, any_of=("저(",)),
)
ROSTER_ORD = len(STRUCTURED) + len(CLASS_NUMBERS)
MODEL_ORD = ROSTER_ORD + 3 + len(CONTEXTUAL)
