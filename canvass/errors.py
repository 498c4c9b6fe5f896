"""The errors that callers may catch; all derive from CanvassError."""


class CanvassError(Exception):
    """Root of all errors raised on purpose."""


class ConfigurationError(CanvassError): ...


class InvalidSettingsError(ConfigurationError): ...


class CodebookError(CanvassError): ...


class DuplicateQuestionIdError(CodebookError): ...


class CircularDependencyError(CodebookError): ...


class UnknownVariableError(CodebookError): ...


class InvalidQuestionDefinitionError(CodebookError): ...


class MetadataParseError(CodebookError): ...


class DataBackendError(CanvassError): ...


class UnsupportedFormatError(DataBackendError): ...


class DataLoadError(DataBackendError): ...


class UnknownColumnError(DataBackendError): ...


class RuleEngineError(CanvassError): ...


class RuleParseError(RuleEngineError): ...


class UnsafeExpressionError(RuleEngineError): ...


class RuleEvaluationError(RuleEngineError): ...


class InvalidRuleDefinitionError(RuleEngineError): ...


class PluginError(CanvassError): ...


class PluginNotFoundError(PluginError): ...


class DuplicatePluginError(PluginError): ...


class ExecutionError(CanvassError): ...


class ManifestError(ExecutionError): ...


class CleaningError(CanvassError): ...


class TransformationError(CleaningError): ...


class ReportingError(CanvassError): ...


class InconsistentRuleSeverityError(ReportingError): ...
