"""A Spark-native language-identification engine."""

from .functions.langs import supported_languages
from .nouns import Detailed, Output, WordScore
from .operators.detect import LanguageDetector
from .operators.train import Model, train_model

__version__ = "0.1.0"

__all__ = ["Detailed", "LanguageDetector", "Model", "Output", "WordScore", "supported_languages", "train_model"]
