"""Patterns, codes and wording of run diagnostics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelflow.functions.text import single_line

# Prefixes of a detail, error codes, advice and headlines.
STAGE_PREFIX = "실패 단계: "
AGENT_PREFIX = "모델 메시지: "
EXIT_PREFIX = "도구 종료 코드: "
OUTPUT_PREFIX = "도구 출력: "
EVENT_PREFIX = "Codex 이벤트 오류: "
STDERR_PREFIX, STDOUT_PREFIX = "stderr: ", "stdout: "
SPAWN_PREFIX = "프로세스 오류: "
ADVICE = "해결 방법: Codex CLI를 최신 버전으로 업데이트한 뒤 프로그램과 Codex를 다시 시작하세요. (codex update)"
COMPATIBILITY_HEADLINE = "Codex 모델 호환성 오류 · prompt_cache_retention을 현재 모델이 지원하지 않습니다."
SAFETY_HEADLINE = "Codex 이미지 생성 안전 필터에 차단되었습니다."
NO_REASON = "Codex 프로세스가 상세 사유 없이 종료되었습니다."
CODES = {
    "exec": "CODEX_EXEC_FAILED",
    "compatibility": "CODEX_MODEL_COMPATIBILITY",
    "result": "CODEX_IMAGE_RESULT_FAILED",
    "safety": "CODEX_IMAGE_SAFETY_BLOCKED",
    "timeout": "CODEX_TIMEOUT",
    "cancelled": "TRANSLATION_CANCELLED",
}
COMPATIBILITY = "(?i)prompt_cache_retention is not supported on this model"
NOISE = "(?i)models cache|shell snapshot"
SAFETY = (
    "(?i)(?:안전 필터|safety filter).{0,160}(?:차단|거부|중단|block|reject|refus)",
    "(?i)(?:성적 묘사|sexual (?:content|depiction)).{0,160}(?:차단|거부|block|reject|refus)",
)
IMAGE_PATH = r"(?i)[A-Za-z]:[\\/][^\r\n`\"<>|]+?\.(?:png|jpe?g|webp)"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
FATAL = "로컬 브리지|Codex 실행|Failed to fetch|연결 토큰"

MAX_DETAILS, STDERR_TAIL, STDOUT_TAIL, DETAIL_LENGTH = 12, 6, 4, 1200


def safety_blocked(text: Column) -> Column:
    """A safety filter refused the picture; looks at the flattened text."""
    flat = single_line(text, DETAIL_LENGTH)
    return flat.rlike(SAFETY[0]) | flat.rlike(SAFETY[1])


def safe_thread_id(value: Column) -> Column:
    return F.coalesce(value.rlike(f"^{UUID}$"), F.lit(False))


def inside_root(path: Column, root: Column) -> Column:
    """Path containment without regard to case; the root itself is not inside."""
    folder = F.concat(F.lower(F.replace(root, F.lit("\\"), F.lit("/"))), F.lit("/"))
    return F.startswith(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), folder)


def error_view(headline: Column, details: Column) -> Column:
    """Headline plus up to twelve details as bullets."""
    shown = F.slice(F.filter(F.coalesce(details, F.array().cast("array<string>")),
                             lambda d: d.isNotNull() & (d != "")), 1, MAX_DETAILS)
    bullets = F.transform(shown, lambda d: F.concat(F.lit("• "), d))
    return F.array_join(F.concat(F.array(headline), bullets), "\n")


def fatal(error: Column) -> Column:
    """An error that ends the whole run."""
    return F.coalesce(error.rlike(FATAL), F.lit(False))
