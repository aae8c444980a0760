"""Argument checks that report every problem of a call at once."""

from numbers import Real


class ArgumentError(ValueError):
    """One error for all the bad arguments of a call."""

    def __init__(self, problems):
        self.problems = tuple(problems)
        super().__init__("; ".join(self.problems))


class Arguments:
    """Collects problems while arguments are read; `done` raises if there were any."""

    def __init__(self):
        self.problems = []

    def require(self, condition, problem):
        if not condition:
            self.problems.append(problem)
        return bool(condition)

    def text(self, name, value):
        """A mandatory, non-empty string."""
        if self.require(value is not None, f"{name} is not provided"):
            self.require(
                isinstance(value, str) and value != "", f"{name} must be a non-empty string"
            )
        return value

    def words(self, name, value, optional=False):
        """A list of words; a string is split on blanks."""
        if value is None:
            self.require(optional, f"{name} is not provided")
            return []
        if isinstance(value, str):
            found = value.split()
        elif isinstance(value, (list, tuple)):
            found = list(value)
        else:
            self.problems.append(f"{name} must be a string or a list of strings")
            return []
        if not self.require(
            all(isinstance(w, str) and w for w in found), f"{name} must hold non-empty strings"
        ):
            return []
        self.require(optional or found, f"{name} is empty")
        return found

    def is_integer(self, name, value):
        return self.require(
            isinstance(value, int) and not isinstance(value, bool), f"{name} must be an integer"
        )

    def positive(self, name, value):
        if self.is_integer(name, value):
            self.require(value > 0, f"{name} must be greater than 0")
        return value

    def number(self, name, value):
        self.require(
            isinstance(value, Real) and not isinstance(value, bool), f"{name} must be a number"
        )
        return value

    def flag(self, name, value):
        self.require(isinstance(value, bool), f"{name} must be True or False")
        return value

    def one_of(self, name, value, allowed):
        self.require(value in allowed, f"{name} must be one of {', '.join(allowed)}")
        return value

    def done(self):
        if self.problems:
            raise ArgumentError(self.problems)
