"""Readers of exported packages, document trees and folder listings."""
