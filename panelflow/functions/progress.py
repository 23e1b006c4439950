"""Column expressions over one progress-log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log line layout.
LINE_PATTERN = r"^\[(\d{2}:\d{2}:\d{2})\] \[작업 #(\d+) · 이미지 #(\d+)\] (.+)$"
# What a message means; the first marker contained in the message wins.
RULES = (
    # marker, stage, state, terminal
    ("전체 취소 요청", "전체 취소", "skipped", False),
    ("사용자 추가 검수 미통과", "사용자 검수 필요", "review", False),
    ("사용자 추가 검수 통과", "검수 통과", "done", False),
    ("사용자 검수 필요", "사용자 검수 필요", "review", False),
    ("자동 검수 3회 미통과", "사용자 검수 필요", "review", False),
    ("자동 검수", "자동 재검수", "running", False),
    ("사용자 추가 검수", "사용자 추가 검수", "running", False),
    ("ZIP 이미지 저장 확인", "완료", "done", True),
    ("ZIP 이미지 저장 실패", "저장 실패", "error", True),
    ("페이지 이미지 교체 확인", "페이지 적용 완료", "done", True),
    ("페이지 이미지 교체 실패", "페이지 적용 실패", "error", True),
    ("클라이언트 연결 종료 감지", "결과 전달 실패", "error", True),
    ("사용자 스킵 완료", "스킵 완료", "skipped", True),
    ("사용자 스킵 요청", "스킵 요청", "skipped", False),
    ("오류 ·", "오류", "error", True),
    ("Codex 오류 상세", "Codex 오류 상세", "error", True),
    ("요청 수신", "요청 수신", "running", False),
    ("대기열 진입", "대기열", "waiting", False),
    ("병렬 처리 시작", "처리 시작", "running", False),
    ("원본 준비 완료", "원본 준비", "running", False),
    ("OCR 강화본 준비 완료", "OCR 강화", "running", False),
    ("OCR 강화본 생성 실패", "OCR 대체 처리", "running", False),
    ("글자 분리본 준비 완료", "글자 분리", "running", False),
    ("글자 분리본 생성 실패", "글자 분리 대체", "running", False),
    ("밝은 글자 반전본 준비 완료", "밝은 글자 분리", "running", False),
    ("밝은 글자 반전본 생성 실패", "밝은 글자 대체", "running", False),
    ("밝은 글자 상세 크롭", "밝은 효과음 확대", "running", False),
    ("밝은 글자 상세 #", "밝은 효과음 확대", "running", False),
    ("좌표 기준본 준비 완료", "좌표 검수", "running", False),
    ("좌표 기준본 생성 실패", "좌표 대체 처리", "running", False),
    ("정밀 판독·초벌 번역 1/3", "1/3 판독·번역", "running", False),
    ("누락·좌표·번역 통합 검수 2/3", "2/3 통합 검수", "running", False),
    ("안전 필터 차단 · 크롭", "로컬 대체 식질", "running", False),
    ("Codex 대사 작업 시트", "Codex 작업 시트", "running", False),
    ("Codex 대사 크롭", "영역 재조립", "running", False),
    ("Codex 대사 영역", "Codex 영역 렌더", "running", False),
    ("Codex 이미지 생성 안전 필터", "안전 필터 차단", "error", True),
    ("Codex 이미지 렌더", "Codex 전체 렌더", "running", False),
    ("렌더 모드", "렌더 방식", "running", False),
    ("품질 검수용 1차 합성", "검수본 합성", "running", False),
    ("품질 검수용 WebP", "검수본 준비", "running", False),
    ("합성 결과 시각 검수 3/3", "3/3 시각 검수", "running", False),
    ("시각 검수 생략", "검수 생략", "running", False),
    ("시각 검수 통과본", "최종 결과 재사용", "running", False),
    ("Codex 분석 시작", "Codex 분석", "running", False),
    ("Codex 분석 중", "Codex 분석", "running", False),
    ("Codex 분석 완료", "분석 완료", "running", False),
    ("일본어 문구", "문구 감지", "running", False),
    ("글자 영역 #", "영역 검수", "running", False),
    ("저신뢰 문구", "영역 검수", "running", False),
    ("번역할 문구 없음", "원본 유지", "skipped", False),
    ("원문 제거 및 한국어 이미지 재생성 시작", "원문 제거", "running", False),
    ("교체용 WebP 생성 완료", "최종 이미지 생성", "running", False),
    ("처리 슬롯", "결과 정리", "running", False),
    ("교체용 이미지 응답 전송 완료", "페이지 적용 대기", "running", False),
)
DEFAULT_STAGE = ("처리 중", "running", False)
SKIP_STAGE = "스킵 요청"
SKIP_DETAIL = "현재 작업 중단 또는 대기 작업 생략 요청됨"
SETTLED_STATES = ("done", "error", "skipped")


def _outcome(stage: str, state: str, terminal: bool) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"), F.lit(state).alias("state"), F.lit(terminal).alias("terminal")
    )


def classify(message: Column) -> Column:
    """(stage, state, terminal) of a message: one folded ``when`` chain, no join."""
    chain = None
    for marker, *outcome in RULES:
        test = message.contains(marker)
        chain = F.when(test, _outcome(*outcome)) if chain is None else chain.when(test, _outcome(*outcome))
    return chain.otherwise(_outcome(*DEFAULT_STAGE))


def source_of(message: Column) -> Column:
    """(source, source_label): the ``<tag>`` first, else the wording, else nulls."""
    tag = F.regexp_extract(message, "<([a-zA-Z0-9_-]+)>", 1)

    def pair(source: Column, label: Column) -> Column:
        return F.struct(source.alias("source"), label.alias("source_label"))

    return (
        F.when(tag == "zip", pair(F.lit("zip"), F.lit("ZIP")))
        .when(tag != "", pair(F.lit("web"), F.concat(F.lit("웹 <"), tag, F.lit(">"))))
        .when(message.contains("ZIP 이미지"), pair(F.lit("zip"), F.lit("ZIP")))
        .when(message.contains("페이지 이미지"), pair(F.lit("web"), F.lit("웹")))
    )


def web_source_name(detail: Column, image_number: Column) -> Column:
    named = F.regexp_extract(detail, r"<[a-zA-Z0-9_-]+> · ([^?]+)$", 1)
    return F.when(named != "", named).otherwise(F.concat(F.lit("웹 이미지 #"), image_number.cast("string")))


def row_key(source: Column, task_number: Column, image_number: Column) -> Column:
    web_number = F.when(task_number > 0, task_number).otherwise(image_number)
    return F.when(source == "zip", F.concat(F.lit("zip:"), image_number.cast("string"))).otherwise(
        F.concat(F.lit("web:"), web_number.cast("string"))
    )
