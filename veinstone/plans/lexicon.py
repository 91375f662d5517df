"""The word lists that query planning and validation must share with their users' data."""

ROLE_TERMS = (
    "expert recommendation", "reviewer recommendation", "evaluation committee", "scientific consortium", "consortium", "committee", "expert",
    "reviewer", "reviewers", "committee member", "committee members", "evaluation expert", "evaluation experts", "evaluation reviewer",
    "evaluation reviewers", "평가위원 추천", "전문가 추천", "평가위원", "심사위원", "전문가", "리뷰어", "자문위원", "컨소시엄", "과학 컨소시엄",
    "위원회", "협의체", "연구단", "사업단",
)
ACTION_TERMS = ("recommendation", "recommend", "recommended", "find", "search", "lookup", "추천해줘", "추천해주세요", "추천해", "추천", "찾아줘", "찾아주세요", "찾아", "매칭")
GENERIC_TERMS = ("experience", "experiences", "capability", "capabilities", "relevant", "suitable", "fit", "fits", "경험", "경력", "역량", "전문성", "관련", "적합", "평가")
CONTEXTUAL = (
    ("과제 평가", r"(?:과제|프로젝트)(?:를|을)?\s*평가"),
    ("기술 평가", r"기술(?:을|를)?\s*평가"),
    ("논문 평가", r"논문(?:을|를)?\s*평가"),
    ("project evaluation", r"\bprojects?\s+evaluation\b|\bevaluate\s+projects?\b"),
    ("technology evaluation", r"\btechnology\s+evaluation\b|\bevaluate\s+technolog(?:y|ies)\b"),
    ("paper evaluation", r"\bpapers?\s+evaluation\b|\bevaluate\s+papers?\b"),
)
GENERIC_SINGLES = (
    "기술", "개발", "연구", "과제", "분석", "시스템", "플랫폼", "컨소시엄", "위원회", "평가", "심사", "리뷰", "과학", "분야", "technology", "development",
    "research", "project", "analysis", "system", "platform", "consortium", "committee", "evaluation", "scientific", "science", "field", "area",
)
GENERIC_PHRASES = ("ai 기반", "데이터 기반", "시스템 개발", "기술 개발", "과학 컨소시엄", "평가 위원회", "평가 위원", "ai based", "data driven", "system development", "technology development", "scientific consortium", "evaluation committee")
STRONG_MARKERS = ("추천", "적합", "전문", "권장", "우수", "높음", "recommend", "recommended", "strong fit", "well suited")
#: Expansion keywords by bundle and branch; `basic` is never expanded.
EXPANSION = {
    "uav": {"art": ("무인기", "UAV", "자율비행"), "pat": ("비행체 제어", "드론 시스템", "원격 조종"), "pjt": ("현장 실증", "자율 비행", "무인 항공 시스템")},
    "fire_response": {"art": ("재난 대응", "소방", "화재 확산 방지"), "pat": ("진압 장치", "소방 시스템", "소화 설비"), "pjt": ("재난 대응", "현장 적용", "화재 감지 및 진압")},
    "ai_vision": {"art": ("영상 분석", "객체 검출", "딥러닝 시각"), "pat": ("이미지 프로세싱", "패턴 인식", "비디오 분석"), "pjt": ("실시간 모니터링", "지능형 관제", "AI 기반 분석")},
}
EXPANSION_SUMMARY = {"uav": "무인기, 드론, 비행체 제어 관련 기술", "fire_response": "화재 진압, 소방 시스템, 재난 대응 관련 기술", "ai_vision": "인공지능 시각 지능, 영상 분석, 객체 검출 기술"}
INSTRUCTIONS = {
    "basic": "Instruct: Find Korean research experts whose academic background, institutional affiliation, and technical expertise match the given query.\nQuery: ",
    "art": "Instruct: Find Korean research experts whose academic publications, papers, or research articles are about the given topic.\nQuery: ",
    "pat": "Instruct: Find Korean research experts whose patents or inventions are related to the given technology.\nQuery: ",
    "pjt": "Instruct: Find Korean research experts who have conducted government-funded research projects related to the given topic.\nQuery: ",
}
BRANCHES = ("basic", "art", "pat", "pjt")
