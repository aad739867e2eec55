"""Unsupervised detectors: fitted by Spark jobs, scored table to table."""

from flowmarrow.operators.detectors.autoencoder import DenseAutoencoder, LstmAutoencoder
from flowmarrow.operators.detectors.base import Detector, choose_detector, load_detector, score_all
from flowmarrow.operators.detectors.iforest import IsolationForest
from flowmarrow.operators.detectors.ocsvm import OneClassSvm

__all__ = [
    "DenseAutoencoder",
    "Detector",
    "IsolationForest",
    "LstmAutoencoder",
    "OneClassSvm",
    "choose_detector",
    "load_detector",
    "score_all",
]
