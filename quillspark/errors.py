"""What can go wrong with a statement."""


class EngineError(Exception):
    """Any error of a statement."""


class SyntaxProblem(EngineError):
    def __init__(self, message: str, at: int = 0, expected: tuple[str, ...] = ()):
        super().__init__(f"{message} (at character {at})")
        self.at, self.expected = at, expected


class NotFound(EngineError):
    """A table, column, index or file that is not there."""


class AlreadyExists(EngineError):
    """A table or index that is there already."""


class Invalid(EngineError):
    """A statement that parses but makes no sense for the table."""
