"""Merkle search trees and corpus operators on PySpark."""
